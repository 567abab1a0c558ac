"""Predictions from similar users, block by block, against brute force; and no table of pairs of users."""

import random
from collections import defaultdict
from math import sqrt

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import neighbours, recommend
from lodeworks.plans.stages import Scratch


def brute_moves(train, test, k):
    by_user, by_item = defaultdict(dict), defaultdict(list)
    for u, i, r in train:
        by_user[u][i] = r
        by_item[i].append(u)

    def sim(a, b):
        common = [(by_user[a][i], by_user[b][i]) for i in by_user[a] if i in by_user[b]]
        n, sx, sy = len(common), sum(x for x, _ in common), sum(y for _, y in common)
        cov = n * sum(x * y for x, y in common) - sx * sy
        vx, vy = n * sum(x * x for x, _ in common) - sx * sx, n * sum(y * y for _, y in common) - sy * sy
        return cov / (sqrt(vx) * sqrt(vy)) if cov else 0.0

    def off(u, i):
        rest = [r for j, r in by_user[u].items() if j != i]
        return by_user[u][i] - sum(rest) / len(rest) if rest else 0.0

    out = {}
    for u, i in test:
        near = sorted((-sim(u, o), o) for o in by_item[i] if o != u) if u in by_user else []
        if near:
            near = near[:k]
            weight = sum(abs(s) for s, _ in near)
            out[u, i] = sum(-s * off(o, i) for s, o in near) / weight if weight else 0.0
    return out


def drawn(seed, users=60, items=15, rows=400):
    draw = random.Random(seed)
    train = sorted({(f"u{draw.randrange(users):03}", f"i{draw.randrange(items):02}"): float(draw.randint(1, 5)) for _ in range(rows)}.items())
    known = {p for p, _ in train}
    test = [p for p in ((f"u{u:03}", f"i{i:02}") for u in range(users) for i in range(items)) if p not in known][::3]
    return [(u, i, r) for (u, i), r in train], test + [("nobody", "i00"), ("u001", "nothing"), train[0][0]]


@pytest.mark.parametrize("k", [None, 1, 10])
def test_moves_equal_brute_force(spark, monkeypatch, k):
    train, test = drawn(3)
    ratings = spark.createDataFrame(train, "user string, item string, rating double")
    asked = spark.createDataFrame(test, "user string, item string")
    want = pytest.approx(brute_moves(train, test, k))
    assert {(r["user"], r["item"]): r["move"] for r in neighbours.moves(asked, ratings, k).collect()} == want
    # one task by hand, with chunks and batches of a few rows
    monkeypatch.setattr(neighbours, "LEAST_BLOCKS", 3)
    coded = neighbours.Coded(ratings)
    rows = coded.dealt(asked.join(coded.users, "user").join(coded.items, "item")).toArrow().to_batches()
    rows = [b.slice(a, 17) for b in rows for a in range(0, len(b), 17)]
    user, item = ({r[1]: r[0] for r in t.collect()} for t in (coded.users, coded.items))
    for chunk, cells in ((1, 1), (40, 90), (10_000, 500)):
        monkeypatch.setattr(neighbours, "CHUNK_ROWS", chunk)
        monkeypatch.setattr(neighbours, "CELLS", cells)
        found = [r for b in neighbours._mover(k)(iter(rows)) for r in b.to_pylist()]
        assert {(user[r["u"]], item[r["i"]]): r["move"] for r in found} == want


def written_rows(monkeypatch):
    """Rows of each table that is written from now on."""
    rows, write = [], Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    return rows


def crowd(spark):
    """500 users who all rated the same three items, and a pair of each with a fourth that they rated or are asked about."""
    every = spark.range(500).select(F.col("id").alias("user"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("item"))
    every = every.withColumn("rating", ((F.col("user") * 7 + F.col("item") * F.col("user") * 3) % 5 + 1).cast("double"))
    asked = (F.col("item") == 3) & (F.col("user") % 2 == 0)
    return every.where(~asked), every.where(asked)


def test_user_cf_writes_no_pairs_of_users(spark, monkeypatch):
    train, test = crowd(spark)
    rows = written_rows(monkeypatch)
    found = recommend.user_cf(test, train)
    assert found.count() == 250 and max(n for _, n in rows) <= 2000


def test_draws_are_written_before_they_are_joined(spark, monkeypatch):
    train, test = crowd(spark)
    rows = written_rows(monkeypatch)
    found = recommend.user_cf(test, train, sample=50)
    assert found.count() == 250
    sizes = dict(rows)
    assert sizes["drawn"] == 250 * 50 and sizes["pairs"] <= sizes["drawn"]


def test_user_cf_top_writes_no_pairs_of_users(spark, monkeypatch):
    train, test = crowd(spark)
    rows = written_rows(monkeypatch)
    found = recommend.user_cf_top(test, train, train.groupBy("item").agg(F.avg("rating").alias("item_mean")))
    assert found.count() == 250 and max(n for _, n in rows) <= 2000


@pytest.mark.parametrize("oracle", [False, True])
def test_hybrid_writes_no_pairs_of_users(spark, monkeypatch, oracle):
    train, test = crowd(spark)
    profiles = [train.groupBy(c).agg(F.avg("rating").alias(f"{c}_mean")) for c in ("user", "item")]
    rows = written_rows(monkeypatch)
    found = recommend.hybrid(test, train, *profiles, oracle=oracle)
    assert found.count() == 250 and max(n for _, n in rows) <= 2000


def test_similarities_are_not_shuffled_by_pair(spark):
    train, _ = drawn(5)
    ratings = spark.createDataFrame(train, "user string, item string, rating double")
    found = recommend.similarities(ratings, "user", "item")
    by_user = defaultdict(dict)
    for u, i, r in train:
        by_user[u][i] = r
    want = {}
    for a in by_user:
        for b in by_user:
            common = [(by_user[a][i], by_user[b][i]) for i in by_user[a] if i in by_user[b]]
            if a != b and common:
                n, sx, sy = len(common), sum(x for x, _ in common), sum(y for _, y in common)
                cov, vx, vy = n * sum(x * y for x, y in common) - sx * sy, n * sum(x * x for x, _ in common) - sx * sx, n * sum(y * y for _, y in common) - sy * sy
                want[a, b] = cov / (sqrt(vx) * sqrt(vy)) if cov else 0.0
    rows = found.collect()
    assert {(r["a"], r["b"]): r["sim"] for r in rows} == pytest.approx(want) and len(rows) == len(want)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["rmse", "hybrid_oracle_rmse"])
def test_error_query_writes_no_pairs_of_users(spark, monkeypatch, name):
    from lodeworks.plans import queries, roles

    train, test = crowd(spark)
    monkeypatch.setattr(roles, "ratings", lambda *_: (train, test))
    rows = written_rows(monkeypatch)
    assert queries.queries()[name](spark, "").first()["rmse"] >= 0 and max(n for _, n in rows) <= 2000


@pytest.mark.parametrize("k", [None, 1, 10])
@pytest.mark.parametrize(("chunk", "cells"), [(1, 1), (40, 90)])
def test_chunks_travel_packed(spark, monkeypatch, k, chunk, cells):
    """A block is sent a row for each chunk, not for each rating."""
    train, test = drawn(4)
    monkeypatch.setattr(neighbours, "LEAST_BLOCKS", 3)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(neighbours, "CELLS", cells)
    ratings = spark.createDataFrame(train, "user string, item string, rating double")
    asked = spark.createDataFrame(test, "user string, item string")
    coded = neighbours.Coded(ratings)
    rows = coded.dealt(asked.join(coded.users, "user").join(coded.items, "item")).toArrow().to_batches()
    assert sum(map(len, rows)) <= 5 * 60 < len(train)  # of a chunk for each user at most: own, asked, and to each block
    user, item = ({r[1]: r[0] for r in t.collect()} for t in (coded.users, coded.items))
    found = [r for b in neighbours._mover(k)(iter(rows)) for r in b.to_pylist()]
    assert {(user[r["u"]], item[r["i"]]): r["move"] for r in found} == pytest.approx(brute_moves(train, test, k))


def test_null_rating_is_no_distance(spark):
    rows = [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 1.0), ("b", "y", 2.0), ("b", "z", None), ("c", "x", 2.0), ("c", "y", 1.0), ("c", "z", 5.0)]
    train = spark.createDataFrame(rows, "user string, item string, rating double")
    asked = spark.createDataFrame([("a", "z")], "user string, item string")
    assert [r["move"] for r in neighbours.moves(asked, train).collect()] == [-1.75]


@pytest.mark.parametrize("k", [None, 10])
def test_moves_of_items_equal_brute_force(spark, k):
    train, test = drawn(6)
    ratings = spark.createDataFrame(train, "user string, item string, rating double")
    asked = spark.createDataFrame(test, "user string, item string")
    want = brute_moves([(i, u, r) for u, i, r in train], [(i, u) for u, i in test], k)
    found = neighbours.moves(asked, ratings, k, of="item", over="user").collect()
    assert {(r["item"], r["user"]): r["move"] for r in found} == pytest.approx(want)


def shelf(spark):
    """Six users who each rated some 190 of 200 items, and are asked about the others."""
    every = spark.range(1200).select((F.col("id") % 6).alias("user"), F.floor(F.col("id") / 6).alias("item"), (F.col("id") * F.col("id") % 5 + 1).cast("double").alias("rating"))
    asked = (F.col("user") * 31 + F.col("item")) % 20 == 0
    return every.where(~asked), every.where(asked)


def test_hybrid_writes_no_pairs_of_items(spark, monkeypatch):
    train, test = shelf(spark)
    profiles = [train.groupBy(c).agg(F.avg("rating").alias(f"{c}_mean")) for c in ("user", "item")]
    rows = written_rows(monkeypatch)
    found = recommend.hybrid(test, train, *profiles)
    assert found.count() == test.count() and max(n for _, n in rows) <= 1200


def of_shelf(spark, monkeypatch, name):
    """The query's error over ``shelf`` and the rows of what it writes."""
    from lodeworks.plans import queries, roles

    train, test = shelf(spark)
    monkeypatch.setattr(roles, "ratings", lambda *_: (train, test))
    rows = written_rows(monkeypatch)
    return queries.queries()[name](spark, "").first()["rmse"], max(n for _, n in rows)


def test_rmse_writes_no_pairs_of_items(spark, monkeypatch):
    error, most = of_shelf(spark, monkeypatch, "rmse")
    assert error > 0 and most <= 1200


def test_oracle_rmse_writes_no_pairs_of_items(spark, monkeypatch):
    error, most = of_shelf(spark, monkeypatch, "hybrid_oracle_rmse")
    assert error > 0 and most <= 1200


def test_draws_meet_no_broadcast_ratings(spark, monkeypatch, small):
    from lodeworks.plans import roles

    plans, write = {}, Scratch.write

    def seen(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", seen)
    train, test = roles.ratings(spark, small)
    found = recommend.user_cf(test, train, sample=50)
    assert found.count() == recommend.known_only(test, train).count()
    for name in ("ratings", "pairs"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name]


def test_hybrid_rounds_as_its_sql(spark, monkeypatch):
    """The mean of 3.0625 and 3.068: by its decimals a half of the fourth place, as a product less."""
    from lodeworks.plans import queries, roles

    own = [(0, i, 3.0 + (i == 0)) for i in range(16)]
    others = [(u, 99, 4.0 if u <= 17 else 3.0) for u in range(1, 251)]
    train, test = (spark.createDataFrame(rows, "user long, item long, rating double") for rows in (own + others, [(0, 99, 3.0)]))
    monkeypatch.setattr(roles, "ratings", lambda *_: (train, test))
    assert [r["prediction"] for r in queries.queries()["hybrid_predict"](spark, "").collect()] == [3.0652]


@pytest.mark.parametrize("chunk", [1, 40])
def test_similarities_travel_packed(spark, monkeypatch, chunk):
    """For similarities too, a block is sent a row for each chunk, not for each rating; users' keys can be of any type."""
    train, _ = drawn(7)
    monkeypatch.setattr(neighbours, "LEAST_BLOCKS", 3)
    ratings = spark.createDataFrame(train, "user string, item string, rating double")
    want = {(r["a"], r["b"]): r["sim"] for r in neighbours.similarities(ratings, "user", "item").collect()}
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(neighbours, "CELLS", 90)
    assert neighbours.Coded(ratings).dealt(None).count() <= 4 * 60 < len(train)  # of a chunk for each user at most: own, and to each block
    found = neighbours.similarities(ratings, "user", "item").collect()
    assert {(r["a"], r["b"]): r["sim"] for r in found} == pytest.approx(want) and len(found) == len(want)
