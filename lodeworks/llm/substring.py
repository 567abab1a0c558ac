"""Substring deduplication by content-defined chunks (operator 7).

A gear hash rolls over a text's bytes, ``h = (h << 1) + gear[byte]``, over the last
16 of them; a chunk ends where the hash is the smallest of the ``AROUND`` before and
behind it, after ``2 * AROUND + 1`` bytes on average and never fewer than ``AROUND``.
An insertion thus moves the borders next to it and no others, and a passage that
two documents share has the same chunks in both, but for its two ends.

1. Tasks send the 64-bit digests of their chunks, packed and without repetition, to
   the range of digests they belong to; digests that more than one chunk has are
   suspected.
2. Chunks are joined with the suspected digests, at any size of the corpus in the
   same way; what matches carries a second, independent digest, so that chunks count
   as equal only if 128 bits agree. Of such a pair's documents the smallest id keeps
   its chunks, the others may lose theirs; the ids are combined in each task first.
3. Neighbouring lost chunks form runs. Runs of at least ``LEAST`` bytes are cut out
   of their document; shorter ones, common phrases, stay.
4. Passages of few bytes or of a short period can have no such run. So each window
   of ``LONG`` words also has a seed, the smallest hash of the ``GRAM`` words in a row
   in it, which goes with the chunks' digests through 1 and 2. Windows with a lost
   seed and no byte in a run are looked up by their own digest, among the windows of
   that seed in other documents, and cut whole if a smaller id has the window too. A window of ``LONG`` words that a smaller id has is
   thus never kept whole. (Of a longer passage that has a run, what lies outside the
   run, fewer than ``LONG`` words on a side, stays.)

Words are divided by white space [\\x20\\x09-\\x0D], which itself does not count.
Edge cases: a null or empty text has no chunks and stays empty; repetition inside
one document is left alone; rows with a null id lose nothing and take nothing from
others; rows with equal ids count as one document; a run that would cut a
character in two is shortened to whole ones; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import Scratch, broadcast_if_small, by_range, id_and_text, map_rows, tidy
from lodeworks.llm.minhash import mixed

#: Bytes on either side among which a border has the smallest hash, largest bytes of a chunk, and bytes that a run has at least to be cut out.
#: A passage of 50 words has some 300 bytes, of which 120 and more lie between borders that do not depend on what is around it.
AROUND, MOST, LEAST = 15, 64, 120
#: Digests that a range is made for.
RANGE_DIGESTS = 1 << 18
#: Words of the shortest passage that is never kept whole, and words of which a seed is the hash; a power of two.
LONG, GRAM = 51, 16
#: Largest tables, in bytes, that are sent to all executors; larger ones are joined by shuffle.
BROADCAST_BYTES = 4 << 20
_RNG = np.random.default_rng(3)
_GEAR = _RNG.integers(0, 1 << 32, 256, dtype=np.uint32)
_NONE = np.uint32(0xFFFFFFFF)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWER = np.cumprod(np.full(MOST, 0x9E3779B97F4A7C15, dtype=np.uint64))
_BYTE_2 = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER_2 = np.cumprod(np.full(MOST, 0xD1342543DE82EF95, dtype=np.uint64))


def _low(h: np.ndarray, k: int) -> np.ndarray:
    """Smallest of each value and the k - 1 behind it; k is a power of two."""
    step = 1
    while step < k:
        h = np.minimum(h, np.append(h[step:], np.full(min(step, len(h)), _NONE)))
        step *= 2
    return h


def ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of the bytes, the last one being their number."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):  # the sum of k terms and the k before them, shifted
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    low = _low(h, 8)
    padded = np.concatenate([np.full(15, _NONE), low, np.full(8, _NONE)])
    before = np.minimum(padded[: len(h)], padded[7 : 7 + len(h)])  # of the 15 before
    behind = np.minimum(low, padded[23 : 23 + len(h)])  # of itself and the 15 behind
    out = np.flatnonzero((h < before) & (h <= behind)) + 1
    if not len(out) or out[-1] != len(data):
        out = np.append(out, len(data))
    starts = np.concatenate([[0], out[:-1]])
    pieces = -(-(out - starts) // MOST)  # long chunks end every MOST bytes
    if (pieces > 1).any():
        first = np.repeat(starts, pieces)
        step = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        out = np.minimum(first + (step + 1) * MOST, np.repeat(out, pieces))
    return out


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (value ^ (value >> np.uint64(32))).view(np.int64)


def chunks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the chunks, and the end; their digests (int64)."""
    return checked_chunks(text, False)[:2]


def checked_chunks(text: str, check: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the chunks, and the end; their digests, and second digests if asked for (int64)."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if not len(data):
        return np.zeros(1, dtype=np.int64), none, none
    stop = ends(data)
    start = np.concatenate([[0], stop[:-1]])
    offset = np.arange(len(data)) - np.repeat(start, stop - start)
    size = (stop - start).astype(np.uint64)
    value = _mixed(np.add.reduceat(_BYTE[data] * _POWER[offset], start) + size)
    second = _mixed(np.add.reduceat(_BYTE_2[data] * _POWER_2[offset], start) + size) if check else none
    return np.append(start, len(data)), value, second


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + y


def _seeds(data: bytes) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Seeds (int64) of all windows of ``LONG`` words, and the hashes of so many words in a row."""
    words = data.split()
    n = len(words) - LONG + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), {}
    of = {1: np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))}
    for k in (1, 2, 4, 8):
        of[2 * k] = _joined(of[k][:-k], of[k][k:])
    low, k, grams = mixed(of[GRAM] ^ np.uint64(0x5851F42D4C957F2D)), 1, LONG - GRAM + 1
    while 2 * k <= grams:
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    return np.minimum(low[:n], low[grams - k : grams - k + n]).view(np.int64), of


def _places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all windows of ``LONG`` words."""
    turn = np.flatnonzero(np.diff(_WHITE[np.frombuffer(data, dtype=np.uint8)], prepend=True, append=True))
    return turn[::2][: 1 - LONG], turn[1::2][LONG - 1 :]


def windows(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds, digests (int64), starts and ends in bytes of all windows of ``LONG`` words."""
    data = text.encode("utf-8", "replace")
    seeds, of = _seeds(data)
    n = len(seeds)
    if not n:
        return (seeds,) * 4
    of[32] = _joined(of[16][:-16], of[16][16:])
    whole, at = None, 0
    for k in (32, 16, 8, 4, 2, 1):
        if LONG & k:
            whole = of[k][at : at + n] if whole is None else _joined(whole, of[k][at : at + n])
            at += k
    return seeds, mixed(whole).view(np.int64), *_places(data)


def stretches(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds that neighbouring windows have in common, and the first and the last of these windows."""
    seeds = _seeds(data)[0]
    first = np.flatnonzero(np.append(True, seeds[1:] != seeds[:-1])[: len(seeds)])
    return seeds[first], first, np.append(first[1:], len(seeds))[: len(first)] - 1


def _ranges(bits: int):
    kind = pa.schema([("range", pa.int32()), ("digests", pa.binary())])

    def packed(held):
        unique, counts = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
        parts = list(by_range(np.repeat(unique, np.minimum(counts, 2)), bits))
        blobs = [p.tobytes() for _, p in parts]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array(blobs, pa.binary())], schema=kind)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                digests = np.concatenate([chunks(text)[1], np.unique(_seeds(text.encode("utf-8", "replace"))[0])])
                held.append(digests)
                n += len(digests)
                if n >= 1 << 20:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    return run


def _repeated(key, table):
    values = np.sort(np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("digests")]))
    return pa.table({"digest": pa.array(np.unique(values[1:][values[1:] == values[:-1]]).view(np.int64), pa.int64())})


def _rows(batches):
    """(digest, check, doc_id, start, end) of the chunks and of the seeds' stretches; a seed's end is negative, and its check 0."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, out = batch.slice(at, 256), []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = text.as_py()
                stops, digests, checks = checked_chunks(text)
                starts, stops = stops[:-1], stops[1:]
                data = text.encode("utf-8", "replace")
                seeds, first, last = stretches(data)
                if len(seeds):
                    opened, closed = _places(data)
                    digests, checks = np.append(digests, seeds), np.append(checks, np.zeros(len(seeds), dtype=np.int64))
                    starts, stops = np.append(starts, opened[first]), np.append(stops, -closed[last])
                out.append((digests, checks, np.full(len(digests), doc_id), starts, stops))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            kinds = (np.int64, np.int64, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], names=["digest", "check", "doc_id", "start", "end"])


def runs(lost: list[tuple[int, int]], least: int = LEAST) -> list[tuple[int, int]]:
    """Spans of neighbouring lost chunks (start, end) that are long enough."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(lost)):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return [(a, b) for a, b in out if b - a >= least]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap made one."""
    return runs(spans, 0)


def left_whole(lost: list[tuple[int, int]], seeds: list[tuple[int, int]], least: int = LEAST) -> list[tuple[int, int]]:
    """Parts of the lost seeds' stretches without a byte of a run, where a window has room."""
    cut = runs(lost, least)
    gaps = list(zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), 1 << 62], strict=True))
    parts = [(max(a, x), min(b, y)) for a, b in seeds for x, y in gaps]
    return [(a, b) for a, b in parts if b - a >= 2 * LONG - 1]


def _doubtful(least: int):
    def each(c):
        found = [left_whole([(x["start"], x["end"]) for x in lost if x["end"] >= 0], [(x["start"], -x["end"]) for x in lost if x["end"] < 0], least) for lost in c["lost"]]
        kept = [k for k, parts in enumerate(found) if parts]
        return {"doubted": [c["lost_by"][k] for k in kept], "parts": [[{"start": a, "end": b} for a, b in found[k]] for k in kept]}

    return lambda: each


def _candidates(c):
    """(digest, seed, doc_id, start, end) of the windows inside the parts of each text."""
    out = {"digest": [], "seed": [], "doc_id": [], "start": [], "end": []}
    for doc_id, text, parts in zip(c["doc_id"], c["text"], c["parts"], strict=True):
        seeds, digests, starts, stops = windows(text)
        inside = np.zeros(len(seeds) + 1, dtype=np.int64)
        for part in parts:
            lo, hi = np.searchsorted(starts, part["start"]), np.searchsorted(stops, part["end"], "right")
            if lo < hi:
                inside[lo] += 1
                inside[hi] -= 1
        inside = np.cumsum(inside)[:-1] > 0
        for name, values in zip(out, (digests, seeds, np.full(len(seeds), doc_id), starts, stops), strict=True):
            out[name].extend(values[inside].tolist())
    return out


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text less the spans of its bytes, each shortened to whole characters, and the spans so shortened."""
    data = text.encode("utf-8", "replace")
    kept, cut, at = [], [], 0
    for a, b in spans:
        while a < b and a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            kept.append(data[at:a])
            cut.append((a, b))
            at = b
    return b"".join([*kept, data[at:]]).decode(), cut


CUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("kept_text", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("source_ids", T.ArrayType(T.LongType())),
    ]
)
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
DOUBTFUL = T.StructType([T.StructField("doubted", T.LongType()), T.StructField("parts", _SPANS)])
CANDIDATE = T.StructType([T.StructField(n, T.LongType()) for n in ("digest", "seed", "doc_id", "start", "end")])


def _cut(least: int, carried: bool):
    def each(c):
        out = {f.name: [] for f in CUT} | ({"carried": c["carried"]} if carried else {})
        for doc_id, text, lost, more in zip(c["doc_id"], c["text"], c["lost"], c["more"], strict=True):
            lost = [x for x in lost or [] if x["end"] >= 0]
            spans = runs([(x["start"], x["end"]) for x in lost], least)
            if more:
                spans = union(spans + [(x["start"], x["end"]) for x in more])
                lost += more
            size = len(text.encode("utf-8", "replace"))
            text, spans = without(text, spans) if spans else (text, spans)
            sources = sorted({x["first"] for x in lost if any(a < x["end"] and x["start"] < b for a, b in spans)}) if spans else []
            values = (doc_id, text, size, sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], sources)
            for f, v in zip(CUT, values, strict=True):
                out[f.name].append(v)
        return out

    return lambda: each


def cut_repeated_passages(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept_text, n_bytes, n_removed, spans, source_ids) for each row; spans are byte offsets in the original text.

    Columns named in ``carry`` come along as the fields of a struct ``carried``.
    """
    scratch = Scratch(df.sparkSession, "substring")
    docs = id_and_text(df, id_col, text_col)
    named = docs.where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(5, int(np.ceil(np.log2(max(1, size / (2 * AROUND + 1) / RANGE_DIGESTS)))))
    packed = named.select("text").mapInArrow(tidy(_ranges(bits)), "range int, digests binary")
    suspected = scratch.write(packed.groupBy("range").applyInArrow(_repeated, "digest long"), "suspected")
    rows = named.mapInArrow(tidy(_rows), "digest long, check long, doc_id long, start int, end int")
    found = scratch.write(rows.join(suspected, "digest", "left_semi"), "found")
    first = found.groupBy("digest", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = scratch.write(first.select("digest", "check", "first"), "first")
    lost = found.join(broadcast_if_small(scratch, first, "first", BROADCAST_BYTES), ["digest", "check"]).where("doc_id <> first")
    place = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "first")
    lost = scratch.write(lost.groupBy(F.col("doc_id").alias("lost_by")).agg(F.collect_set(place).alias("lost")), "lost")
    more = _whole_windows(scratch, named, found, lost, least)
    if more is not None:
        lost = lost.join(more, F.col("lost_by") == F.col("more_by"), "left").drop("more_by")
    else:
        lost = lost.withColumn("more", F.lit(None).cast("array<struct<start:bigint,end:bigint,first:bigint>>"))
    scratch.keep("lost", "more")
    whole = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    joined = whole.join(lost, F.col("doc_id") == F.col("lost_by"), "left").drop("lost_by")
    schema = T.StructType([*CUT.fields, joined.schema["carried"]]) if carry else CUT
    return map_rows(joined, _cut(least, bool(carry)), schema)


def _whole_windows(scratch: Scratch, docs: DataFrame, found: DataFrame, lost: DataFrame, least: int) -> DataFrame | None:
    """(more_by, more): windows without a byte in a run that a smaller id has too; None if there are none to look up."""
    doubtful = scratch.write(map_rows(lost.where(F.exists("lost", lambda x: x["end"] < 0)), _doubtful(least), DOUBTFUL), "doubtful")
    doubtful = broadcast_if_small(scratch, doubtful, "doubtful", BROADCAST_BYTES)
    candidates = docs.join(doubtful, F.col("doc_id") == F.col("doubted")).select("doc_id", "text", "parts")
    candidates = scratch.write(map_rows(candidates, lambda: _candidates, CANDIDATE), "candidates")
    if candidates.isEmpty():
        return None
    seeds = scratch.write(candidates.select(F.col("seed").alias("digest")).distinct(), "seeds")
    places = found.where("end < 0").join(broadcast_if_small(scratch, seeds, "seeds", BROADCAST_BYTES), "digest", "left_semi")
    places = places.groupBy(F.col("doc_id").alias("held_by")).agg(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), (-F.col("end")).cast("long").alias("end"))).alias("parts"))
    places = broadcast_if_small(scratch, scratch.write(places, "places"), "places", BROADCAST_BYTES)
    holders = map_rows(docs.join(places, F.col("doc_id") == F.col("held_by")).select("doc_id", "text", "parts"), lambda: _candidates, CANDIDATE)
    asked = scratch.write(candidates.select("digest").distinct(), "asked")
    holders = holders.select("digest", "doc_id").join(broadcast_if_small(scratch, asked, "asked", BROADCAST_BYTES), "digest", "left_semi")
    holder = scratch.write(holders.groupBy("digest").agg(F.min("doc_id").alias("first")), "holder")
    more = candidates.join(broadcast_if_small(scratch, holder, "holder", BROADCAST_BYTES), "digest").where("doc_id > first")
    more = more.groupBy(F.col("doc_id").alias("more_by")).agg(F.collect_set(F.struct("start", "end", "first")).alias("more"))
    return scratch.write(more, "more")
