"""Jobs from source files to sinks, and what they report."""

import csv
import json
from pathlib import Path

import pytest

from lodeworks import jobs
from lodeworks.sources import readers, sinks


def read(path) -> list[str]:
    return [line for f in sorted(Path(path).glob("part-*")) for line in f.read_text().splitlines()]


@pytest.fixture
def files(tmp_path):
    businesses = [("b1", "Ames", "NV"), ("b2", "Reno, East", "NV"), ("b3", "Troy", "IA")]
    reviews = [(f"u{k % 5}", f"b{1 + k % 3}", 1.0 + k % 5, f"201{7 + k % 2}-03-04") for k in range(30)]
    (tmp_path / "business.json").write_text("".join(json.dumps({"business_id": b, "city": c, "state": s, "stars": 3.0}) + "\n" for b, c, s in businesses))
    (tmp_path / "review.json").write_text("".join(json.dumps({"user_id": u, "business_id": b, "stars": s, "date": d}) + "\n" for u, b, s, d in reviews))
    for name in ("train", "test"):
        rows = sorted({(u, b): s for u, b, s, _ in reviews if (u[1] + b[1] in ("01", "12")) == (name == "test")}.items())
        (tmp_path / f"{name}.csv").write_text("user_id,business_id,stars\n" + "".join(f"{u},{b},{s}\n" for (u, b), s in rows))
    (tmp_path / "pairs.csv").write_text("user_id,business_id\n" + "".join(f"{u},{b}\n" for u, b in sorted({(u, b) for u, b, _, _ in reviews})))
    (tmp_path / "points.csv").write_text("".join(f"{k},{k % 2},{(k % 2) * 50 + k % 7},{k % 5}\n" for k in range(200)))
    return {"dir": tmp_path, "reviews": reviews, "cities": {b: c for b, c, _ in businesses}}


def run(spark, name, capsys, **arguments):
    found = jobs.main([name, *[f"{k}={v}" for k, v in arguments.items()]], spark)
    line = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert line["job"] == name and line["duration"] > 0
    return found


def test_counts_to_files(spark, files, capsys):
    d, reviews = files["dir"], files["reviews"]
    run(spark, "review_summary", capsys, reviews=d / "review.json", out=d / "summary")
    found = json.loads("".join(read(d / "summary")))
    assert (found["n_review"], found["n_review_year"], found["n_user"], found["n_business"]) == (30, 15, 5, 3)
    assert found["top10_user"][0] == ["u0", 6] and found["top10_business"] == [["b1", 10], ["b2", 10], ["b3", 10]]
    layout = run(spark, "partition_layout", capsys, reviews=d / "review.json", out=d / "layout", n_partition=3)
    assert layout["customized"]["n_partition"] == 3 and sum(layout["customized"]["n_items"]) == sum(layout["default"]["n_items"]) == 30
    for append in ("false", "true"):
        found = run(spark, "city_stars", capsys, reviews=d / "review.json", businesses=d / "business.json", out=d / "stars", append=append)
    assert set(found["seconds"]) == {"all", "ten"} and len(found["top10"]) == 3
    rows = [r for r in csv.reader(read(d / "stars")) if r != ["city", "stars"]]
    means = {c: round(sum(int(s) for _, b, s, _ in reviews if files["cities"][b] == c) / 10, 1) for c in files["cities"].values()}
    assert sorted(rows) == sorted([c, str(m)] for c, m in means.items() for _ in range(2))  # written twice, the second time appended
    run(spark, "state_pairs", capsys, reviews=d / "review.json", businesses=d / "business.json", out=d / "nv")
    rows = [line for line in read(d / "nv") if line != "user_id,business_id"]
    assert rows == [f"{u},{b}" for u, b in sorted((u, b) for u, b, _, _ in reviews if b != "b3")]


def test_sets_to_files(spark, files, capsys):
    d = files["dir"]
    run(spark, "frequent_itemsets", capsys, pairs=d / "pairs.csv", out=d / "sets", support=4)
    assert "".join(read(d / "sets")).endswith("('b1', 'b2', 'b3')")
    assert run(spark, "similar_pairs", capsys, ratings=d / "train.csv", out=d / "similar", exact="true")["n_pairs"] == 3
    assert "business_id_2" in read(d / "similar")[0]
    pairs = [line.split(",")[:2] for line in read(d / "similar") if not line.startswith("business_id_1")]
    assert pairs == [["b1", "b2"], ["b1", "b3"], ["b2", "b3"]]
    assert run(spark, "neighbour_order", capsys, ratings=d / "train.csv", out=d / "near")["n_pairs"] % 2 == 0
    run(spark, "communities", capsys, pairs=d / "pairs.csv", out=d / "labels", least=2)
    assert read(d / "labels") == ["'u0', 'u1', 'u2', 'u3', 'u4'"]
    run(spark, "girvan_newman", capsys, pairs=d / "pairs.csv", betweenness=d / "edges", out=d / "parts", least=2)
    assert len(read(d / "edges")) == 10 and read(d / "edges")[0].startswith("('u")


@pytest.mark.parametrize("case", [1, 2, 3, 4, 5])
def test_predictions_to_file(spark, files, capsys, case):
    d = files["dir"]
    found = run(spark, "predict", capsys, train=d / "train.csv", test=d / "test.csv", out=d / "p", case=case)
    rows = [line for line in read(d / "p") if not line.startswith("user_id")]
    assert 0 < len(rows) <= 2 and found["rmse"] >= 0 and sum(found["errors"].values()) == len(rows)
    assert any(line.startswith("user_id") for line in read(d / "p"))


def test_clusters_and_rates_to_files(spark, files, capsys):
    d = files["dir"]
    assert run(spark, "clusters", capsys, points=d / "points.csv", out=d / "bfr", k=2, min_cluster=2)["n_total"] == 200
    assert [line.split(":")[0] for line in read(d / "bfr")[:5]] == [f"Round {k}" for k in range(1, 6)]
    (d / "cities").mkdir()
    (d / "cities" / "a.json").write_text('{"city": "Ames"}\n{"city": "Troy"}\n{"city": "Ames"}\n{}\n')
    assert run(spark, "bloom_rates", capsys, cities=d / "cities", out=d / "rates")["n_batches"] == 1
    assert read(d / "rates")[0] == "Time,FPR" and read(d / "rates")[1].endswith(",0.0") and len(read(d / "rates")[1].split(",")[0]) == 19


def test_arguments(spark, capsys):
    assert jobs.main([]) is None
    assert "state_pairs reviews businesses out [state=NV]" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        jobs.main(["state_pairs", "reviews=x", "more=1"], spark)


def test_batches_append_once(spark, tmp_path):
    write = sinks.append_batch(str(tmp_path / "out"))
    for batch in (0, 1, 1):
        write(spark.createDataFrame([(f"t{batch}", 0.5)], "Time string, FPR double"), batch)
    assert sorted(r["Time"] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()) == ["t0", "t1"]


def test_lines_from_a_socket(spark, tmp_path):
    import socket
    import threading

    server = socket.create_server(("localhost", 0))

    def serve():
        while True:
            try:
                client, _ = server.accept()
            except OSError:
                return
            client.sendall(b'{"city": "Ames"}\n{"city": "Troy"}\n')

    threading.Thread(target=serve, daemon=True).start()
    rows = readers.decode_json(readers.socket_lines(spark, server.getsockname()[1]), readers.CITY)
    query = rows.writeStream.format("memory").queryName("from_socket").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            query.processAllAvailable() if query.lastProgress else query.awaitTermination(0.5)
            if spark.table("from_socket").count() >= 2:
                break
        assert {r["city"] for r in spark.table("from_socket").collect()} == {"Ames", "Troy"}
    finally:
        query.stop()
        server.close()
