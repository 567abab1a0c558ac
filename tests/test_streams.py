"""Streams replayed from files give what the batch forms give."""

import random

import pytest
from pyspark.sql import functions as F

from lodeworks.functions.scalar import SKETCH_PAIRS
from lodeworks.operators import sketches
from lodeworks.sources import readers
from lodeworks.streaming import sketches as streams


def events(n=120, values=40, seed=1):
    rng = random.Random(seed)
    return [(k, f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", f"city {rng.randrange(values)}") for k in range(n)]


def replay(spark, tmp_path, rows, schema, parts):
    """A stream of the rows, in ``parts`` micro-batches."""
    folder = tmp_path / "in"
    folder.mkdir()
    size = -(-len(rows) // parts)
    for p in range(parts):
        df = spark.createDataFrame(rows[p * size : (p + 1) * size], schema)
        df.coalesce(1).select(F.to_json(F.struct("*")).alias("value")).write.text(str(tmp_path / f"part-{p}"))
        text = next((tmp_path / f"part-{p}").glob("part-*.txt")).read_text()
        (folder / f"{p}.json").write_text(text)
        import os
        import time

        os.utime(folder / f"{p}.json", (time.time() - 1000 + p, time.time() - 1000 + p))
    return readers.decode_json(readers.file_lines(spark, str(folder)), spark.createDataFrame([], schema).schema)


def run(stream, tmp_path, mode="update"):
    found = []
    query = streams.start(stream, lambda df, k: found.append([tuple(r) for r in df.collect()]), str(tmp_path / "checkpoint"), mode=mode)
    assert query.awaitTermination(120)
    return found


def brute_bloom(rows):
    bits, seen, fp, tn = set(), set(), 0, 0
    for _, _, city in rows:
        x = int(city.encode().hex(), 16)
        own = {(a * x + b) % 200 for a, b in SKETCH_PAIRS}
        if own <= bits:
            fp += city not in seen
        else:
            tn += 1
            bits |= own
        seen.add(city)
    return fp, tn


def test_bloom_stream_and_batch(spark, tmp_path):
    rows, schema = events(300, 120), "id long, ts string, city string"
    found = run(streams.bloom_stream(replay(spark, tmp_path, rows, schema, 3), "city", "ts", "id"), tmp_path)
    assert [b[0][1:3] for b in found] == [brute_bloom(rows[:n]) for n in (100, 200, 300)]
    batch = spark.createDataFrame(rows, schema)
    out = sketches.bloom_fpr(batch, "city", ["ts", "id"], F.floor(F.col("id") / 100)).orderBy("batch").collect()
    assert [(r["fp"], r["tn"]) for r in out] == [brute_bloom(rows[:n]) for n in (100, 200, 300)]
    assert all(0 <= r["fpr"] <= 1 for r in out)


def test_windows_stream_and_batch(spark, tmp_path):
    rows, schema = events(), "id long, ts string, city string"
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    expected = {tuple(r) for r in sketches.fm_windows(batch, "ts", "city").collect()}
    stream = streams.fm_stream(replay(spark, tmp_path, rows, schema, 2), "city", "ts", late="1 hour")
    last = {}
    for part in run(stream, tmp_path):
        last |= {r[0]: r for r in part}
    assert set(last.values()) == expected


def test_trending_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, [f"t{rng.randrange(6)}" for _ in range(rng.randrange(3))]) for k in range(90)]
    found = run(streams.trending_stream(replay(spark, tmp_path, rows, "id long, tags array<string>", 2), "tags", "id", size=1000), tmp_path)
    from collections import Counter

    tagged = [t for _, t in rows if t]
    count = Counter(x for t in tagged for x in t)
    levels = sorted(set(count.values()), reverse=True)[:3]
    assert {r[1:] for r in found[-1]} == {(t, n, levels.index(n) + 1) for t, n in count.items() if n in levels}
    assert found[-1][0][0] == len(tagged)


def test_reservoir_is_bounded(spark, tmp_path):
    rows = [(k, ["a"]) for k in range(500)]
    found = run(streams.trending_stream(replay(spark, tmp_path, rows, "id long, tags array<string>", 2), "tags", "id", size=100), tmp_path)
    assert found[-1] == [(500, "a", 100, 1)]
    assert sketches.reservoir(spark.range(500), "id", 100).distinct().count() == 100


@pytest.mark.parametrize("n", [0, 3])
def test_small_reservoir(spark, n):
    assert sketches.reservoir(spark.range(n), "id").count() == n
