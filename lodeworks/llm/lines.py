"""Line deduplication with two Bloom filters (operator 8).

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z
lower-cased. Keys of at least ``MIN_POINTS`` code points that occur in at least
``MIN_DOCUMENTS`` documents lose all their lines except those of the largest
doc_id that holds them.

1. Each task sends the 64-bit hashes of its documents' keys, packed, to the range
   of hashes they belong to. There each one passes two Bloom filters: a hash that
   the first has seen enters the second. A second look at the packed hashes keeps
   those that the second filter knows: all repeated hashes, and a few others. The
   number of ranges follows the corpus, so the filters' size does not.
2. Only lines with a suspected hash leave their task, with their place and the SHA-256
   of their key, by which they are counted exactly and the document that keeps them is
   chosen; rows of a document and a key, then counts and largest ids, are combined in
   each task first.
3. The places that a text loses come back to it by its id and digest. What is kept
   are the slices between them, so that the work is linear in a text's lines.

Edge cases: a null or empty text is one empty line; rows with equal ids are one
document, and each of them loses what it would lose alone; each row with a null id
counts as a document, and with any other id among the holders the largest of those
keeps the lines and rows with a null id lose them (if all ids are null, none loses
any); texts of any length and number of lines pass whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, broadcast_if_small, by_range, gathered, id_and_text

MIN_POINTS = 20
MIN_DOCUMENTS = 3
#: Hashes that a range is made for.
RANGE_HASHES = 1 << 18
#: There are as many ranges as that many bits tell apart, at most; past 17 billion hashes they grow.
MOST_BITS = 16
#: Bits of a Bloom filter for each of these, and its hash functions.
BITS_EACH, PROBES = 16, 4
#: Largest written tables that are sent to all executors; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Fixed value.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


class TwoBlooms:
    """Once-seen and twice-seen filters of 64-bit hashes, a bit for each place."""

    def __init__(self, hashes: int):
        self.size = np.uint64(max(1024, hashes * BITS_EACH))
        self.once = np.zeros(int(self.size) // 8 + 1, dtype=np.uint8)
        self.twice = np.zeros(int(self.size) // 8 + 1, dtype=np.uint8)

    def _places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and bits of the places of each value, a row for each probe."""
        a = values * np.uint64(0x9E3779B97F4A7C15)
        b = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        places = np.stack([((a + np.uint64(k) * b) >> np.uint64(11)) % self.size for k in range(PROBES)])
        return (places >> np.uint64(3)).astype(np.int64), np.left_shift(1, (places & np.uint64(7)).astype(np.uint8), dtype=np.uint8)

    def add(self, values: np.ndarray) -> None:
        """Add hashes, each at most once a call."""
        at, bit = self._places(values)
        seen = (self.once[at] & bit).all(axis=0)
        np.bitwise_or.at(self.twice, at[:, seen], bit[:, seen])
        np.bitwise_or.at(self.once, at, bit)

    def suspected(self, values: np.ndarray) -> np.ndarray:
        at, bit = self._places(values)
        return values[(self.twice[at] & bit).all(axis=0)]


def _ranges(bits: int):
    kind = pa.schema([("range", pa.int32()), ("hashes", pa.binary())])

    def pack(batches):
        for values in gathered(batches):
            unique, counts = np.unique(values, return_counts=True)
            values = np.repeat(unique, np.minimum(counts, 2))  # more than two of one task tell nothing new
            parts = list(by_range(values, bits))
            blobs = [part.tobytes() for _, part in parts]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array(blobs, pa.binary())], schema=kind)

    return pack


def _suspect(key, table):
    blobs = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("hashes")]
    filters = TwoBlooms(sum(map(len, blobs)))
    for values in blobs:
        unique, counts = np.unique(values, return_counts=True)
        filters.add(unique)
        filters.add(unique[counts > 1])
    found = [np.unique(filters.suspected(values)) for values in blobs]
    return pa.table({"hash": pa.array(np.unique(np.concatenate(found)).view(np.int64), pa.int64())})


def drop_repeated_lines(
    df: DataFrame, min_points: int = MIN_POINTS, min_documents: int = MIN_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for each row."""
    scratch = Scratch(df.sparkSession, "lines")
    docs = id_and_text(df, id_col, text_col)
    lines, mark = F.split("text", "\n", -1), F.unhex(F.md5("text"))
    long_keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_points))
    keys = docs.select("doc_id", F.explode(long_keys).alias("key")).withColumn("hash", F.xxhash64("key"))
    rows = scratch.write(keys.select("hash"), "hashes")
    bits = min(MOST_BITS, max(5, int(np.ceil(np.log2(max(1, rows.count()) / RANGE_HASHES)))))
    packed = rows.mapInArrow(_ranges(bits), "range int, hashes binary")
    suspected = scratch.write(packed.groupBy("range").applyInArrow(_suspect, "hash long"), "suspected")
    rowed = docs.select("doc_id", mark.alias("mark"), F.monotonically_increasing_id().alias("row"), lines.alias("lines"))  # once a row, not a line
    placed = rowed.select("doc_id", "mark", "row", F.posexplode("lines").alias("place", "line")).withColumn("key", line_key(F.col("line")))
    placed = placed.where(F.char_length("key") >= min_points).withColumn("hash", F.xxhash64("key"))
    found = placed.join(broadcast_if_small(scratch, suspected, "suspected", BROADCAST_BYTES), "hash", "left_semi")
    found = found.select("doc_id", "mark", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row"), "place", F.unhex(F.sha2("key", 256)).alias("key"))
    found = scratch.write(found, "found")
    # a document holds a key once, however often; rows with a null id are told apart by where they were written
    held = found.select("key", "doc_id", "row").distinct()
    repeated = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("owner"))
    repeated = scratch.write(repeated.where((F.col("n") >= min_documents) & F.col("owner").isNotNull()).select("key", "owner"), "repeated")
    lost = found.join(broadcast_if_small(scratch, repeated, "repeated", BROADCAST_BYTES), "key").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    lost = lost.groupBy(F.col("doc_id").alias("lost_by"), F.col("mark").alias("lost_mark")).agg(F.array_sort(F.collect_set("place")).alias("lost"))
    lost = scratch.write(lost, "lost")
    scratch.keep("lost")
    lost = broadcast_if_small(scratch, lost, "lost", BROADCAST_BYTES)
    joined = docs.withColumn("mark", mark).join(lost, F.col("doc_id").eqNullSafe(F.col("lost_by")) & (F.col("mark") == F.col("lost_mark")), "left")
    out = joined.withColumn("lines", lines)
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), "lost"), F.concat("lost", F.array(F.size("lines"))), lambda a, b: F.struct((a + 2).alias("first"), (b - a - 1).alias("n")))
    kept = F.flatten(F.transform(gaps, lambda x: F.slice(F.col("lines"), x["first"], x["n"])))
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
