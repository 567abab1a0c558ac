"""Every registered query of the library that has SQL gives the SQL's rows."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import connect, same

from lodeworks.operators import itemsets
from lodeworks.plans.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    same(spark, small, queries()[name], oracle_sql()[name])


def test_partition_profile(spark, small):
    rows = queries()["partition_profile"](spark, small).collect()
    assert [r["partition_id"] for r in sorted(rows)] == list(range(8))
    assert sum(r["n_items"] for r in rows) == spark.read.parquet(f"{small}/lineitem.parquet").count()


def test_candidates_hold_all_frequent_sets(spark, small):
    frequent = {r["items"] for r in queries()["son_itemsets"](spark, small).collect()}
    assert frequent <= {r["items"] for r in queries()["son_candidates"](spark, small).collect()}


def test_als_is_better_than_the_middle(spark, small):
    from lodeworks.plans import roles

    test = roles.ratings(spark, small)[1]
    found = queries()["als_predictions"](spark, small)
    rows = test.join(found, ["user", "item"]).collect()
    assert len(rows) == found.count() > 0 and all(1 <= r["prediction"] <= 5 for r in rows)
    assert sum((r["rating"] - r["prediction"]) ** 2 for r in rows) / len(rows) < 4


def test_clusters_cover_all_points(spark, small):
    n = spark.read.parquet(f"{small}/embeddings.parquet").count()
    rows = queries()["bfr_clusters"](spark, small).collect()
    assert len({r["index"] for r in rows}) == len(rows) == n and all(r["cluster"] >= -1 for r in rows)
    assert [sum((r["n_discard"], r["n_compressed"], r["n_retained"])) for r in sorted(queries()["bfr_rounds"](spark, small).collect())][-1] == n


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture
def wide_orders(spark, small, tmp_path) -> str:
    """Tables in which 450 orders hold the same six brands."""
    for table in Path(small).iterdir():
        if table.stem not in ("lineitem", "part"):
            (tmp_path / table.name).symlink_to(table)
    pq.write_table(pa.table({"p_partkey": range(6), "p_brand": [f"Brand#{k}" for k in range(6)]}), tmp_path / "part.parquet")
    rows = [(order, part) for order in range(450) for part in range(6)]
    pq.write_table(pa.table({"l_orderkey": [r[0] for r in rows], "l_partkey": [r[1] for r in rows]}), tmp_path / "lineitem.parquet")
    return str(tmp_path)


def test_frequent_itemsets_all_has_the_sizes_of_its_sql(spark, wide_orders):
    same(spark, wide_orders, queries()["frequent_itemsets_all"], oracle_sql()["frequent_itemsets_all"])


def test_itemset_text_has_the_sizes_of_its_sql(spark, wide_orders):
    same(spark, wide_orders, queries()["itemset_text"], oracle_sql()["itemset_text"])


def test_son_itemsets_has_the_sizes_of_its_sql(spark, wide_orders):
    same(spark, wide_orders, queries()["son_itemsets"], oracle_sql()["son_itemsets"])


def test_largest_bounds_sizes_only(spark):
    df = spark.createDataFrame([(list("abcde"),)] * 5 + [(list("abc"),)] * 3, "items array<string>")
    rows = lambda found: {(tuple(r["items"]), r["n"]) for r in found.collect()}
    every = rows(itemsets.frequent_itemsets(df, 4))
    assert max(len(s) for s, _ in every) == 5
    assert rows(itemsets.son(df, 4, 3)[1]) == rows(itemsets.frequent_itemsets(df, 4, 3)) == {(s, n) for s, n in every if len(s) <= 3}


@pytest.mark.parametrize("name", ["frequent_itemsets_all", "son_itemsets"])
def test_itemset_query_has_every_size(spark, wide_orders, name):
    """The six brands that 450 orders share are a frequent itemset, too, in the query and in its SQL."""
    rows = {r["items"]: r["n"] for r in queries()[name](spark, wide_orders).collect()}
    assert len(rows) == 2**6 - 1 and rows[",".join(f"Brand#{k}" for k in range(6))] == 450
    assert rows == dict(connect(wide_orders).sql(oracle_sql()[name]).fetchall())


def test_candidates_have_every_size(spark, wide_orders):
    assert max(r["items"].count(",") for r in queries()["son_candidates"](spark, wide_orders).collect()) == 5
