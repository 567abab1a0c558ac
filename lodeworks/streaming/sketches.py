"""Streams (survey A4-A6, K1-K8, J25-J27): Bloom filter, distinct estimates of sliding windows, reservoir with trending tags.

Each function takes a streaming DataFrame and returns one, or takes what
``foreachBatch`` hands on; state lives in the state store or, for ``foreachBatch``,
in tables, never in the driver's globals. The Bloom filter and the reservoir are
one state each by their nature: their order is that of the events.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeworks.functions.scalar import SKETCH_PAIRS, byte_fold
from lodeworks.operators.sketches import BLOOM_BITS, fm_estimate, fm_maxima

BLOOM_OUT = "batch_time timestamp, fp long, tn long, fpr double"
RESERVOIR_OUT = "n_seen long, tag string, n long, rank int"


def _bloom_step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    bits, seen, fp, tn = state.get if state.exists else ([], [], 0, 0)
    bits, seen, now = set(bits), set(seen), None
    rows = pd.concat(list(batches)).sort_values("key")
    for value, x, ts in zip(rows["value"], rows["x"], rows["ts"], strict=True):
        own = {(a * int(x) + b) % BLOOM_BITS for a, b in SKETCH_PAIRS}
        if not own <= bits:
            bits |= own
            tn += 1
        elif value not in seen:
            fp += 1
        seen.add(value)
        now = ts if now is None else max(now, ts)
    state.update((sorted(bits), sorted(seen), fp, tn))
    yield pd.DataFrame({"batch_time": [now], "fp": [fp], "tn": [tn], "fpr": [fp / (fp + tn) if fp + tn else 0.0]})


def bloom_stream(events: DataFrame, value: str, ts: str, key: str) -> DataFrame:
    """Cumulative (batch_time, fp, tn, fpr) after each micro-batch; values of a batch are met in the order of ``key``."""
    text = F.col(value).cast("string")
    rows = events.where(F.col(value).isNotNull()).select(
        F.lit(0).alias("all"), text.alias("value"), byte_fold(text, BLOOM_BITS).alias("x"), F.col(ts).cast("timestamp").alias("ts"), F.col(key).alias("key")
    )
    state = "bits array<int>, seen array<string>, fp long, tn long"
    return rows.groupBy("all").applyInPandasWithState(_bloom_step, BLOOM_OUT, state, "update", "NoTimeout")


def fm_stream(events: DataFrame, value: str, ts: str, length: str = "30 seconds", slide: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """(window_start, n_distinct, estimate) of sliding windows of event time (J26, K2, K6); events later than ``late`` are dropped.

    Two aggregates in the state store: values of a window are made different first, then counted and sketched.
    """
    rows = events.where(F.col(value).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    text = F.col(value).cast("string")
    sums = rows.groupBy(F.window("_ts", length, slide)).agg(F.size(F.collect_set(text)).cast("long").alias("n_distinct"), *fm_maxima(text))
    return sums.select(F.col("window.start").alias("window_start"), "n_distinct", fm_estimate([F.col(f"z{k}") for k in range(6)]).alias("estimate"))


def _reservoir_step(size: int, seed: int):
    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, kept = state.get if state.exists else (0, [])
        kept = [list(k) for k in kept]
        for tags in pd.concat(list(batches)).sort_values("key")["tags"]:
            n += 1
            if n <= size:
                kept.append(list(tags))
            else:
                draw = random.Random(f"{seed}/{n}")
                if draw.random() < size / n:
                    kept.pop(draw.randrange(size))
                    kept.append(list(tags))
        state.update((n, kept))
        counts = pd.Series([t for tags in kept for t in tags], dtype="object").value_counts()
        levels = np.sort(counts.unique())[::-1][:3]
        rows = [(n, tag, int(c), int(np.flatnonzero(levels == c)[0]) + 1) for tag, c in counts.items() if c in levels]
        yield pd.DataFrame(sorted(rows, key=lambda r: (r[3], r[1])), columns=["n_seen", "tag", "n", "rank"])

    return step


def trending_stream(posts: DataFrame, tags: str, key: str, size: int = 100, seed: int = 0) -> DataFrame:
    """After each micro-batch, the tags with one of the three largest counts in a reservoir of ``size`` posts that have tags."""
    rows = posts.where(F.size(tags) > 0).select(F.lit(0).alias("all"), F.col(tags).cast("array<string>").alias("tags"), F.col(key).alias("key"))
    return rows.groupBy("all").applyInPandasWithState(_reservoir_step(size, seed), RESERVOIR_OUT, "n long, kept array<array<string>>", "update", "NoTimeout")


def start(stream: DataFrame, sink, checkpoint: str, every: str | None = None, mode: str = "update") -> StreamingQuery:
    """Start a stream into a ``foreachBatch`` function, by processing time (K1, K4), or over all that is there and then end (K8)."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
