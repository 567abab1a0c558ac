from itertools import combinations_with_replacement

import numpy as np
import pytest
from helpers import documents, rows_of
from pyspark.sql import functions as F

from lodeworks.llm import embedding, quality, queries, sharding, warc

# sharding


def brute_minimax(sizes, shards):
    best = {(0, 0): 0}
    n = len(sizes)
    for s in range(1, shards + 1):
        for j in range(n + 1):
            options = [max(best[s - 1, i], sum(sizes[i:j])) for i in range(j + 1) if (s - 1, i) in best]
            if options:
                best[s, j] = min(options)
    return best[shards, n]


@pytest.mark.parametrize("seed", range(25))
def test_minimax(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 50, rng.integers(1, 14))
    shards = int(rng.integers(1, 6))
    capacity, cuts = sharding.minimax_cuts(sizes, shards)
    assert capacity == brute_minimax(sizes.tolist(), shards)
    parts = [p.sum() for p in np.split(sizes, cuts)]
    assert sum(parts) == sizes.sum() and len(parts) <= shards and max(parts) <= capacity
    if len(parts) == shards:
        every = [np.diff([0, *c, len(sizes)]) for c in combinations_with_replacement(range(len(sizes) + 1), shards - 1)]
        sums = [[p.sum() for p in np.split(sizes, np.cumsum(e)[:-1])] for e in every]
        assert min(parts) == max(min(x) for x in sums if max(x) <= capacity)


def test_shards(spark, small):
    rows = queries.op2_sharding(spark, small).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, small, "documents").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    import zlib

    groups, slots, sizes = {}, {}, np.zeros(24)
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 8, zlib.crc32(text), "bytes") and r["grown_shard"] is None
        groups.setdefault(text, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(len(g) == 1 for g in groups.values()) and all(0 <= s < 24 for s in slots)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)
    assert sizes.max() <= sizes.sum() / 24 + largest


def test_shard_edges(spark):
    df = documents(spark, [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b" * 1000)])
    rows = sharding.shard_by_bytes(df, 3).collect()
    assert sorted(r["size"] for r in rows) == [8, 8, 9, 9, 1008]
    assert len({r["shard"] for r in rows if r["size"] == 8}) == 1 and len({r["shard"] for r in rows if r["doc_id"] == 3}) == 1
    assert sharding.shard_by_bytes(df.where("false"), 3).count() == 0


# embeddings


def brute_links(vectors, least=0.95):
    x = np.array([v for _, v in vectors], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return (x @ x.T >= least) & ~np.eye(len(x), dtype=bool)


@pytest.mark.parametrize("block", [7, 512])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((150, 16))
    near = base[rng.integers(0, 150, 200)] + rng.standard_normal((200, 16)) * 0.12
    hub = base[0] + rng.standard_normal((60, 16)) * 0.05
    vectors = list(enumerate([*base.tolist(), *near.tolist(), *hub.tolist(), base[3].tolist(), base[3].tolist()]))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    links = brute_links(vectors)
    low = np.arange(len(vectors))
    for _ in range(len(vectors)):
        new = np.minimum(low, np.where(links, low, len(low)).min(axis=1))
        if (new == low).all():
            break
        low = new
    found = embedding.near_vectors(df).orderBy("vec_id").collect()
    monkeypatch.setattr(embedding, "FEW", 0)
    found = embedding.near_vectors(df).orderBy("vec_id").collect()
    true, seen = links.sum(), sum(r["n_links"] for r in found)
    assert seen % 2 == 0  # each pair found counts at both ends
    assert 0.999 * true <= seen <= true
    assert sum(r["component_id"] == low[r["vec_id"]] for r in found) >= len(found) - 2
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in found)


def test_vector_edges(spark):
    one, nan = [1.0, 0.0], [float("nan"), 1.0]
    rows = [(1, one), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, nan), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, one), (9, [0.0, 1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("cell", F.lit(2))
    found = rows_of(embedding.near_vectors(df), "vec_id", "n_links", "component_id", "kept")
    expected = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *[(k, 0, k, True) for k in range(3, 11)], (None, 0, None, True)]
    assert [r for r in found if r[0] is not None] == sorted([e for e in expected if e[0] is not None], key=repr)
    assert embedding.near_vectors(df.where("false")).count() == 0
    assert embedding.near_vectors(df.where("vec_id = 4")).first()["n_links"] == 0


@pytest.mark.parametrize("few", [0, 2048])
def test_vectors_of_several_lengths(spark, monkeypatch, few):
    monkeypatch.setattr(embedding, "FEW", few)
    rng = np.random.default_rng(12)
    rows = []
    for width in (2, 3, 8):
        base = rng.standard_normal((30, width))
        rows += [*base.tolist(), *(base[:20] + 0.01 * rng.standard_normal((20, width))).tolist()]
    rows += [[1e200, 1e200, 0.0], [1e-200, 1e-200, 0.0], [1.0, 1.0, 0.0]]
    vectors = list(enumerate(rows))
    found = {r["vec_id"]: r["n_links"] for r in embedding.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    for width in (2, 3, 8):
        own = [(k, [x / max(map(abs, v)) for x in v]) for k, v in vectors if len(v) == width]
        want = dict(zip([k for k, _ in own], brute_links(own).sum(axis=1).tolist(), strict=True))
        if few:
            assert {k: found[k] for k in want} == want
        else:
            assert sum(found[k] for k in want) >= 0.99 * sum(want.values())


def test_fit_in_little_memory():
    import tracemalloc

    sample = embedding.units(np.random.default_rng(13).standard_normal((2048, 64)))
    tracemalloc.start()
    index = embedding.MultiIndex.fit(sample, 300_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.first) == 1083 and 1 <= index.cells <= 1083**2 and peak < 300 << 20


def test_ranks_are_those_of_the_grid():
    rng = np.random.default_rng(14)
    d, e, own = rng.random(40), rng.random(30), 0.9
    assert np.searchsorted(np.sort(e), own - d, "left").sum() == (d[:, None] + e < own).sum()


def test_traversal_is_in_order():
    rng = np.random.default_rng(10)
    a, b = rng.random(9), rng.random(7)
    found = embedding.traversal(a, b, 63)
    sums = (a[:, None] + b).ravel()
    assert sorted(found) == list(range(63)) and (np.diff(sums[found]) >= 0).all()


# WARC


def test_revisits(spark):
    h = lambda **kw: {k.replace("_", "-"): v for k, v in kw.items()}
    rows = [
        ("r1", "http://www.A.com/x/", 10, "response", 200, h(ETag='"1"', Date="d1", Server="s"), "p1"),
        ("r2", "https://a.com/x#f", 20, "response", 200, h(ETag='"2"', Last_Modified="m"), "p2"),
        ("r3", "https://a.com/x", 25, "response", 404, h(ETag='"3"'), "p3"),
        ("v1", "http://a.com/x?utm_source=q", 15, "revisit", 304, h(etag='W/"1"', date="d2", server="t"), None),
        ("v2", "http://a.com/x", 30, "revisit", 304, h(etag='"1"'), None),
        ("v3", "http://a.com/x", 31, "revisit", 304, h(Last_Modified="m"), None),
        ("v4", "http://a.com/x", 20, "revisit", 304, h(etag='"1"'), None),
        ("v5", "http://a.com/x", 5, "revisit", 304, {}, None),
        ("v6", "http://a.com/x", 32, "revisit", 304, None, None),
        ("v7", "http://a.com/x", 33, "revisit", 304, {}, "p2"),
        ("v8", None, 33, "revisit", 304, {}, "p2"),
        ("v9", "http://a.com/x", None, "revisit", 304, {}, "p2"),
    ]
    df = spark.createDataFrame(rows, "record_id string, url string, ts long, kind string, status int, headers map<string,string>, payload_digest string").withColumn("slice", F.lit(1))
    found = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r["outcome"], r["refers_to"]) for k, r in found.items()} == {
        "v1": ("resolved", "r1"), "v2": ("mismatch", None), "v3": ("resolved", "r2"), "v4": ("resolved", "r1"), "v5": ("no_response", None),
        "v6": ("no_validator", None), "v7": ("resolved", "r2"), "v8": ("no_response", None), "v9": ("no_response", None),
    }
    assert found["v1"]["headers"] == {"etag": 'W/"1"', "date": "d2", "server": "s"} and found["v1"]["payload_digest"] == "p1"
    assert warc.resolve_revisits(df.where("false")).count() == 0


def test_bursts_ties_and_wrong_dates(spark, monkeypatch):
    """One busy URL with a burst, equal times, a date of year 9999 and repeated records, against a search by hand."""
    monkeypatch.setattr(warc, "SLICE_POINTS", 5)
    monkeypatch.setattr(warc, "MOST_SLICES", 16)
    rng = np.random.default_rng(15)
    times = [*rng.integers(1000, 1010, 40).tolist(), *rng.integers(0, 5000, 60).tolist(), 0, 253_402_300_799]
    rows = []
    for k, ts in enumerate(map(int, times)):
        kind = "response" if k % 2 else "revisit"
        rows.append((None if k == 51 else f"x{k:03d}", "http://a.com/x" if k % 7 else "http://b.com/", ts, kind, 200 if k % 5 else 404, {"etag": "1"}, f"p{k}"))
    rows += [rows[3], rows[4], rows[4], (rows[3][0], *rows[3][1:6], "q")]
    df = spark.createDataFrame(rows, "record_id string, url string, ts long, kind string, status int, headers map<string,string>, payload_digest string")
    full = {}
    for r in rows:
        if r[3] == "response" and r[4] == 200:
            key = (r[1], r[2], r[0] or "")
            full[key] = max(full.get(key, ""), r[6])
    want = []
    for r in rows:
        if r[3] == "revisit":
            best = max((k for k in full if k[0] == r[1] and k[1] < r[2]), key=lambda k: k[1:], default=None)
            want.append((r[0], r[2], "resolved" if best else "no_response", (best[2] or None) if best else None, full[best] if best else None))
    found = rows_of(warc.resolve_revisits(df), "record_id", "ts", "outcome", "refers_to", "payload_digest")
    assert found == sorted(want, key=repr)


def test_canonical_urls(spark):
    urls = {"HTTP://WWW.Ex.com:80/A/?b=2&utm_x=1&a=1#z": "ex.com/A?a=1&b=2", "https://m.ex.com": "m.ex.com", "ex.com/": "ex.com", "": "", "http://ex.com?q": "ex.com?q"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["c"] for r in df.withColumn("c", warc.canonical_url(F.col("u"))).collect()} == urls


# quality


def test_boosting_learns_and_flattens():
    rng = np.random.default_rng(11)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.fit(x[:3000], y[:3000])
    assert ((forest.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97
    row, out = x[3000], forest.base
    for t in range(len(forest.feature)):
        k = 0
        while k < forest.feature.shape[1]:
            k = 2 * k + 1 + (row[forest.feature[t, k]] > forest.threshold[t, k])
        out += forest.leaf[t, k - forest.feature.shape[1]]
    assert forest.raw(row[None])[0] == pytest.approx(out)
    assert (quality.fit(np.zeros((0, 5)), np.zeros(0)).score(x[:3]) == 0.5).all()
    constant = quality.fit(x[:50], np.ones(50)).score(x[:3])
    assert (constant > 0.9).all()


def test_held_out_quality(spark):
    import os

    sf = os.environ.get("TEST_QUALITY_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    rows = queries.op10_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    order = s[y == 1][:, None] > s[y == 0]
    assert order.mean() > 0.97
    assert np.mean([(r["predicted"] == r["quality"]) for r in rows]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_edges(spark):
    df = documents(spark, [(1, None), (2, ""), (2, ""), (None, "text"), (4, "a" * 100_000)])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(6)] + [(77, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    forest = quality.train(df, labels)
    scores = rows_of(quality.score_documents(df, forest), "doc_id", "score")
    assert len(scores) == 5 and all(0 <= s <= 1 for _, s in scores)
    assert quality.train(df, labels.where("false")).score(np.zeros((1, quality.N_FEATURES)))[0] == 0.5
    assert quality.score_documents(df.where("false"), forest).count() == 0
