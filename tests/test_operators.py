import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import cluster, counts, graph, itemsets, partitions, recommend, similarity

BASKETS = [["1", "2", "3"], ["1", "2"], ["1", "3"]]


def brute_itemsets(baskets, support):
    items = sorted({x for b in baskets for x in b})
    found = {}
    for k in range(1, len(items) + 1):
        level = {c: n for c in combinations(items, k) if (n := sum(set(c) <= set(b) for b in baskets)) >= support}
        if not level:
            break
        found |= level
    return found


def as_dict(df):
    return {tuple(r["items"]): r["n"] for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_itemsets_do_not_depend_on_partitions(spark, parts):
    df = spark.createDataFrame([(b,) for b in BASKETS], "items array<string>").repartition(parts)
    expected = brute_itemsets(BASKETS, 2)
    candidates, frequent = itemsets.son(df, 2)
    assert as_dict(frequent) == expected == as_dict(itemsets.frequent_itemsets(df, 2))
    assert {tuple(r["items"]) for r in candidates.collect()} >= set(expected)
    assert as_dict(itemsets.frequent_of_size(df, 2, 2)) == {k: v for k, v in expected.items() if len(k) == 2}


def test_local_frequent_is_exact():
    baskets = [frozenset(b) for b in (["a", "b", "c", "d"], ["a", "b", "c"], ["a", "c", "d"], ["b", "c", "d"], ["a", "b", "d"])]
    for support in (1, 2, 3, 4):
        assert set(itemsets.local_frequent(baskets, support)) == set(brute_itemsets(baskets, support))


def test_contained_is_exact(monkeypatch):
    draw = random.Random(2)
    part = [frozenset(draw.sample(range(40), draw.randrange(9))) for _ in range(300)]
    far = [frozenset(x + 10**6 * draw.randrange(2000) for x in b) for b in part]  # too many items for numbers of 62 bits
    for baskets, cells in ((part, 1 << 18), (part, 3), (far, 1 << 18)):
        monkeypatch.setattr(itemsets, "CELLS", cells)
        for size in (1, 2, 3, 6):
            candidates = sorted({c for b in baskets[::2] for c in combinations(sorted(b), size)})
            assert itemsets.contained(baskets, candidates) == {c: sum(b.issuperset(c) for b in baskets) for c in candidates}


def test_joined_recount_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "BROADCAST_BYTES", -1)
    df = spark.createDataFrame([(b,) for b in BASKETS], "items array<string>")
    assert as_dict(itemsets.son(df, 2)[1]) == brute_itemsets(BASKETS, 2)


def test_no_baskets(spark):
    df = spark.createDataFrame([], "items array<string>")
    assert itemsets.frequent_itemsets(df, 2).count() == 0
    assert itemsets.son(df, 2)[1].count() == 0


def test_ordinals_and_ties(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "c", "b", None]], "k string")
    assert {tuple(r) for r in counts.ordinals(df, "k").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert [tuple(r) for r in counts.top_k(df, "k", 2).collect()] == [("b", 2), (None, 1)]
    assert counts.dense_top(df, "k", 1).count() == 1
    many = spark.range(5000).selectExpr("cast(id * 7 % 5000 as string) as k")
    found = {r["k"]: r["ordinal"] for r in counts.ordinals(many, "k").collect()}
    assert found == {k: j for j, k in enumerate(sorted(found))}


def test_partition_profile_has_empty_partitions(spark):
    df = spark.createDataFrame([(1,)] * 5, "k int")
    profile = partitions.partition_profile(df, 6, "k").collect()
    assert len(profile) == 6 and sum(r["n_items"] for r in profile) == 5 and max(r["n_items"] for r in profile) == 5
    assert partitions.partition_profile(df).agg(F.sum("n_items")).first()[0] == 5


def test_similarity_is_verified(spark):
    rows = [(k, m) for k in range(12) for m in range(k, k + 6)]
    df = spark.createDataFrame(rows, "k int, m int")
    sets = {k: set(range(k, k + 6)) for k in range(12)}
    truth = {(a, b) for a, b in combinations(range(12), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    exact = similarity.exact_jaccard(df, "k", "m")
    assert {(r["a"], r["b"]) for r in exact.collect()} == truth
    found = similarity.lsh_jaccard(df, "k", "m")
    assert {(r["a"], r["b"]) for r in found.collect()} <= truth
    r = similarity.recall(found, exact).first()
    assert r["precision"] == 1.0 and r["n_truth"] == len(truth)
    with pytest.raises(ValueError):
        similarity.overlaps(df, "k", "m", 0)


RATINGS = [("u1", "i1", 5.0), ("u1", "i2", 3.0), ("u2", "i1", 4.0), ("u2", "i2", 2.0), ("u2", "i3", 4.0), ("u3", "i3", 1.0)]


def test_recommenders_by_hand(spark):
    train = spark.createDataFrame(RATINGS, "user string, item string, rating double")
    test = spark.createDataFrame([("u1", "i3", 4.0), ("u9", "i1", 2.0), ("u1", "i9", 3.0)], "user string, item string, rating double")
    known = {(r["user"], r["item"]) for r in recommend.known_only(test, train).collect()}
    assert known == {("u1", "i3")}
    # u1 and u2 agree on i1, i2 (Pearson 1); u3 shares nothing with u1 and has one rating only
    p = {(r["user"], r["item"]): r["prediction"] for r in recommend.user_cf(test, train).collect()}
    assert p == {("u1", "i3"): pytest.approx(4.0 + (4.0 - 3.0))}
    user_mean, item_mean = train.groupBy("user").agg(F.avg("rating").alias("user_mean")), train.groupBy("item").agg(F.avg("rating").alias("item_mean"))
    top = {(r["user"], r["item"]): r["prediction"] for r in recommend.user_cf_top(test, train, item_mean).collect()}
    assert top["u9", "i1"] == pytest.approx(4.5) and top["u1", "i9"] == pytest.approx(4.0)
    # i3's only rater with u1's items is u2: one pair each, so no similarity
    assert recommend.item_cf_first(test, train).first()["prediction"] == 3.0
    assert {(r["user"], r["item"]): r["prediction"] for r in recommend.item_cf_top(test, train, user_mean).collect()}["u1", "i3"] == pytest.approx(4.0)
    sampled = [recommend.user_cf(test, train, sample=20, seed=3).collect() for _ in range(2)]
    assert sampled[0] == sampled[1]
    hybrid = recommend.hybrid(test, train, user_mean, item_mean).where("item = 'i3'").first()
    assert hybrid["prediction"] == pytest.approx((5.0 + 4.0) / 2 if abs(5.0 - 4.0) < 1 else (4.0 + 2.5) / 2)


EDGES = ["sa", "sb", "ac", "bc", "cp", "pt", "se", "ef", "fq", "qt"]
PARENT_COUNT = {"pt": 9.333333, "fq": 8.166667, "qt": 8.166667, "as": 6.416667, "bs": 6.416667, "ac": 6.416667, "bc": 6.416667, "cp": 10.666667, "es": 10.666667, "ef": 9.333333}


@pytest.mark.parametrize("measure", [graph.edge_betweenness, graph.edge_betweenness_frontier])
@pytest.mark.parametrize("exact", [False, True])
def test_betweenness(spark, measure, exact):
    edges = spark.createDataFrame([tuple(e) for e in EDGES], "src string, dst string")
    expected = PARENT_COUNT | ({"fq": 8.0, "qt": 8.0, "as": 6.5, "bs": 6.5, "ac": 6.5, "bc": 6.5} if exact else {})
    found = {"".join(sorted((r["src"], r["dst"]))): r["betweenness"] for r in measure(edges, exact).collect()}
    assert found == {k: pytest.approx(v, abs=1e-5) for k, v in expected.items()}


def test_two_cliques(spark):
    clique = lambda nodes: list(combinations(nodes, 2))
    edges = spark.createDataFrame(clique([1, 2, 3, 4]) + clique([5, 6, 7, 8]) + [(4, 5)], "src long, dst long")
    assert tuple(graph.top_edge(graph.edge_betweenness(edges)).first())[:2] == (4, 5)
    for original in (False, True):
        found, quality = graph.girvan_newman(edges, original_adjacency=original)
        assert [r["members"] for r in found.collect()] == [[1, 2, 3, 4], [5, 6, 7, 8]] and quality < 1
    labels = graph.label_propagation(edges)
    assert [r["members"] for r in graph.communities(labels).collect()] == [[1, 2, 3, 4], [5, 6, 7, 8]]
    q = graph.modularity(edges, labels).first()["modularity"]
    assert q == pytest.approx(2 * (12 / 26 - (13 / 26) ** 2))


def test_components_of_a_path(spark):
    n = 40
    order = [(k * 17) % n for k in range(n)]
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(100, 101), (101, 102)], "src long, dst long")
    found = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert found == dict.fromkeys(range(n), 0) | {100: 100, 101: 100, 102: 100}
    assert graph.connected_components(edges.where("false")).count() == 0


def test_bfr_finds_far_groups(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [40, 0], [0, 40]])
    rows = [(k, k % 3, (centres[k % 3] + rng.normal(size=2)).tolist()) for k in range(600)] + [(600, 9, [500.0, 500.0])]
    points = spark.createDataFrame(rows, "index long, label int, features array<double>")
    labels, rounds = cluster.bfr(points.select("index", "features"), k=3, init_multiplier=2, min_cluster=3)
    labels.persist()
    log = rounds.orderBy("round").collect()
    assert [r["round"] for r in log] == [1, 2, 3, 4, 5]
    assert log[-1]["n_discard"] + log[-1]["n_compressed"] + log[-1]["n_retained"] == 601
    p = cluster.purity(labels, points.where("label < 9").select("index", "label")).first()
    assert p["purity"] > 0.95
    assert labels.where("index = 600").first()["cluster"] == -1 and labels.count() == 601


def test_summaries_add_up():
    import numpy as np

    x = np.random.default_rng(0).normal(size=(20, 3))
    part = lambda v: cluster.Summary(np.array([len(v)], float), v.sum(axis=0)[None], (v * v).sum(axis=0)[None])
    both = part(x[:8]).joined(part(x[8:]))
    assert np.allclose([both.n.sum(), *both.total.sum(axis=0)], [20, *x.sum(axis=0)])
    assert cluster.merge_near(both, 100).tolist() == [0, 0] and cluster.merge_near(both, 0).tolist() == [0, 1]


def test_latest_of_equal_dates_is_the_largest(spark):
    rows = [(1, 1, 2.0, "b"), (1, 1, 5.0, "b"), (1, 1, 4.0, "b"), (1, 1, 9.0, "a"), (1, 2, 1.0, "a"), (2, 1, 3.0, "a"), (2, 1, 1.0, "b")]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "user long, item long, rating double, date string").coalesce(1)
        found = {(r["user"], r["item"]): r["rating"] for r in counts.last_rating(df, "user", "item", "rating", "date").collect()}
        assert found == {(1, 1): 5.0, (1, 2): 1.0, (2, 1): 1.0}


def test_components_take_few_rounds(spark):
    n = 2000
    edges = spark.createDataFrame([(k, k + 1) for k in range(n - 1)] + [(5000, 5001), (5001, 5001), (None, 3)], "src long, dst long")
    found, rounds = graph.star_rounds(edges)
    assert {r["node"]: r["component"] for r in found.collect()} == dict.fromkeys(range(n), 0) | {5000: 5000, 5001: 5000}
    assert rounds <= 15


def test_candidates_do_not_depend_on_arrow_batches(spark):
    import random

    draw = random.Random(1)
    df = spark.createDataFrame([(sorted(draw.sample("abcdefghij", 4)),) for _ in range(600)], "items array<string>").repartition(2).persist()
    key, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    for size in (7, 10_000):
        spark.conf.set(key, size)
        found.append({tuple(r["items"]) for r in itemsets.local_candidates(df, 60, rows=100).collect()})
    spark.conf.unset(key)
    assert found[0] == found[1] and found[0]
    rare = itemsets.local_candidates(df, 2, rows=10)  # a part of ten baskets would make all their subsets candidates
    assert {tuple(r["items"]) for r in rare.collect()} >= set(brute_itemsets([r["items"] for r in df.collect()], 2))


def test_needed_similarities_by_both_ways(spark):
    import random

    draw = random.Random(2)
    rows = list({(u, i): float(draw.randint(1, 5)) for u, i in ((draw.randint(1, 30), draw.randint(1, 12)) for _ in range(150))}.items())
    train = spark.createDataFrame([(u, i, r) for (u, i), r in rows], "user long, item long, rating double")
    every = {(r["a"], r["b"]): r["sim"] for r in recommend.similarities(train, "item", "user").collect()}
    few = [(1, 2), (5, 3), (4, 4), (3, 5)]
    for asked in (few, [(a, b) for a in range(1, 13) for b in range(1, 13)]):
        needed = spark.createDataFrame(asked, "a long, b long")
        found = {(r["a"], r["b"]): r["sim"] for r in recommend.needed_similarities(train, "item", "user", needed).collect()}
        want = {p: s for p, s in every.items() if p in asked or p[::-1] in asked}
        assert found == {p: pytest.approx(s) for p, s in want.items()}


def test_written_tables_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from lodeworks.plans import stages

    cluster_session = lambda **kw: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: kw.get("conf")), sparkContext=SimpleNamespace(master=kw["master"], getCheckpointDir=lambda: kw.get("dir")))
    with pytest.raises(ValueError):
        stages.shared_folder(cluster_session(master="spark://host:7077"))
    assert stages.shared_folder(cluster_session(master="yarn", dir="hdfs://x/y/")) == "hdfs://x/y"
    assert stages.shared_folder(cluster_session(master="yarn", conf="hdfs://z")) == "hdfs://z"
    scratch = stages.Scratch(spark, "test")
    monkeypatch.setattr(stages, "_WRITTEN", [scratch])
    assert scratch.write(spark.range(3), "t").count() == 3
    target, fs = scratch._path(scratch.root)
    assert fs.exists(target)
    stages.release()
    assert not fs.exists(target) and not stages._WRITTEN


def test_ordinals_whatever_adaptive_planning_does(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "256k")
    try:
        for n in (20_000, 30_000, 60_000, 20_000, 25_000):
            found = counts.ordinals(spark.range(3 * n).selectExpr(f"id % {n} as k"), "k")
            assert found.where("ordinal = k").count() == found.count() == n
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("measure", [graph.edge_betweenness, graph.edge_betweenness_frontier])
def test_betweenness_without_edges(spark, measure):
    for rows in ([], [(7, 7)]):
        found = measure(spark.createDataFrame(rows, "src long, dst long"))
        assert found.columns == ["src", "dst", "betweenness"] and found.count() == 0


@pytest.mark.parametrize("carried", [256, 2])
def test_lsh_pairs_carry_their_sets(spark, monkeypatch, carried):
    """The whole pairs whether sets go along with the bands or are fetched, and no table of the candidates in the first case."""
    from lodeworks.plans.stages import Scratch

    names, write = [], Scratch.write

    def seen(self, df, name):
        names.append(name)
        return write(self, df, name)

    rows = [(k, m) for k in range(40) for m in range(k % 7, k % 7 + 4 + k % 3)] + [(3, 3), (None, 1), (50, None), (51, 0), (51, None), (52, 0)]
    df = spark.createDataFrame(rows, "k int, m int")
    members = {}
    for k, m in rows:
        if k is not None and m is not None:
            members.setdefault(k, set()).add(m)
    met = {(r["a"], r["b"]) for r in similarity.lsh_candidates(df.where("m IS NOT NULL").distinct(), "k", "m").collect()}
    want = {(a, b): len(members[a] & members[b]) / len(members[a] | members[b]) for a, b in met}
    monkeypatch.setattr(similarity, "CARRIED", carried)
    monkeypatch.setattr(Scratch, "write", seen)
    found = [tuple(r) for r in similarity.lsh_jaccard(df, "k", "m").collect()]
    assert sorted(found) == sorted((a, b, x) for (a, b), x in want.items() if x >= 0.5) and len(found) > 100
    assert ("candidates" in names) == (carried == 2)
