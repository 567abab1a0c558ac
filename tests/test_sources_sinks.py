import json
from pathlib import Path

from lodeworks.sources import readers, sinks


def lines(df):
    return [r["value"] for r in df.collect()]


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id": "u", "business_id": "b", "stars": 4.5, "date": "2018-01-02", "more": 1}\n{"user_id": "v"}\n')
    rows = readers.read_json_lines(spark, str(tmp_path / "r.json"), readers.REVIEW).collect()
    assert tuple(rows[0]) == ("u", "b", 4.5, "2018-01-02") and rows[1]["stars"] is None
    (tmp_path / "p.csv").write_text("one,two\nu,b\nv,c\n")
    assert {tuple(r) for r in readers.read_headered_csv(spark, str(tmp_path / "p.csv"), readers.PAIR).collect()} == {("u", "b"), ("v", "c")}
    (tmp_path / "x.csv").write_text("0,1,0.5,2\n1,0,-1,3e0\n\n")
    assert [tuple(r) for r in readers.read_points(spark, str(tmp_path / "x.csv")).orderBy("index").collect()] == [(0, 1, [0.5, 2.0]), (1, 0, [-1.0, 3.0])]
    decoded = readers.decode_json(spark.createDataFrame([('{"city": "Ames"}',), ("broken",)], "value string"), readers.CITY)
    assert [r["city"] for r in decoded.collect()] == ["Ames", None]
    found = readers.track(readers.from_rows(spark, [("A Movie!",), ("m.sic",), (None,)], "t string"), "t", ["movie", "m.s"])
    assert {r["t"] for r in found.collect()} == {"A Movie!", "m.sic"}


def test_itemset_text(spark):
    frequent = spark.createDataFrame([(["a", "b"], 3), (["b"], 4), (["a"], 5)], "items array<string>, n long")
    text = sinks.itemset_report(frequent.where("size(items) = 1"), frequent)
    assert text == "Candidates:\n('a'),('b')\n\nFrequent Itemsets:\n('a'),('b')\n\n('a', 'b')"


def test_graph_text(spark):
    edges = spark.createDataFrame([("u", "v", 1.5), ("a", "b", 4.0), ("a", "c", 1.5)], "src string, dst string, betweenness double")
    assert lines(sinks.betweenness_lines(edges)) == ["('a', 'b'), 4.0", "('a', 'c'), 1.5", "('u', 'v'), 1.5"]
    groups = spark.createDataFrame([(["x", "y", "z"],), (["p", "q"],), (["a", "b"],)], "members array<string>")
    assert lines(sinks.community_lines(groups)) == ["'a', 'b'", "'p', 'q'", "'x', 'y', 'z'"]


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1.5)], "city string, stars double")
    sinks.write_csv(df, str(tmp_path / "q"), header="city, stars")
    sinks.write_csv(df, str(tmp_path / "u"), legacy_unquoted=True)
    read = lambda p: "".join(f.read_text() for f in sorted(Path(p).glob("part-*")))
    assert '"a, b",1.5' in read(tmp_path / "q") and "city, stars" in read(tmp_path / "q").replace('"', "")
    assert read(tmp_path / "u") == "city,stars\na, b,1.5\n"
    assert json.loads(sinks.json_document(df)) == {"city": "a, b", "stars": 1.5}


def test_bfr_report(spark):
    rounds = spark.createDataFrame([(2, 5, 1, 2, 3), (1, 4, 0, 0, 1)], "round int, n_discard long, n_compressed_sets long, n_compressed long, n_retained long")
    labels = spark.createDataFrame([(1, -1), (0, 2)], "index long, cluster int")
    assert lines(sinks.bfr_report(rounds, labels)) == ["Round 1: 4,0,0,1", "Round 2: 5,1,2,3", "0,2", "1,-1"]
