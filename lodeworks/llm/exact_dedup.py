"""Exact duplicates by counting quotient filters (operator 3).

Texts are equal if the same after white space ``[\\x20\\x09-\\x0D]`` is deleted.

1. One pass writes (doc_id, fingerprint, code points, digest) of each row.
2. Each partition builds counting quotient filters of its fingerprints, one for
   each range of them; those of a range merge by their sorted remainders.
3. Fingerprints with a count above one are suspected. Only the texts behind them
   are read again and grouped by their bytes, combined in each task first, so
   that a text with a million copies is sent once by a task. Each class of equal
   bytes becomes a row; a digest that stood for two different texts would end the
   run with an error.
4. Rows whose fingerprint occurs once are their own class.

A range holds about ``RANGE_ROWS`` fingerprints up to two billion rows; beyond that
there are ``1 << MOST_BITS`` ranges, which grow (30 MB each at 50 billion rows), so
that what a task sends to a range stays worth a filter. Copies only raise a count,
so that no task gathers a group of copies.

Edge cases: a null text counts as empty, and all empty texts are equal; of equal
texts the longest original stays, then the smallest id, null ids last, and of rows
that are alike in all this exactly one; texts of any length pass whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, broadcast_if_small, by_range, gathered, id_and_text, tidy
from lodeworks.llm.quotient import CountingQuotientFilter

RANGE_ROWS = 1 << 17
MOST_BITS = 14
#: Largest table of suspected fingerprints, in bytes, that is sent to all executors; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: White space that does not count (fixed value).
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def _filters(bits: int):
    kind = pa.schema([("range", pa.int32()), ("filter", pa.binary())])

    def build(batches):
        for values in gathered(batches):
            values = values[np.argsort(values >> np.uint64(64 - bits), kind="stable")]
            parts = list(by_range(values, bits))
            filters = [CountingQuotientFilter.of(part, shared_bits=bits).dump() for _, part in parts]
            yield pa.RecordBatch.from_arrays([pa.array([prefix for prefix, _ in parts], pa.int32()), pa.array(filters, pa.binary())], schema=kind)

    return build


def _merge(bits: int):
    def merge(key, table):
        prefix = key[0].as_py()
        filters = [CountingQuotientFilter.load(x.as_py()) for x in table.column("filter")]
        while len(filters) > 1:  # pairwise, so that each fingerprint is moved a logarithmic number of times
            pairs = [filters[k : k + 2] for k in range(0, len(filters), 2)]
            filters = [p[0].merged(p[1], prefix, bits) if len(p) == 2 else p[0] for p in pairs]
        values, counts = filters[0].items(prefix, bits)
        return pa.table({"fp": pa.array(values[counts > 1].view(np.int64), pa.int64()), "n": pa.array(counts[counts > 1], pa.int64())})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the values that occur more than once in the only column of ``fingerprints`` (long)."""
    bits = min(MOST_BITS, max(5, int(np.ceil(np.log2(max(1, rows) / RANGE_ROWS)))))
    built = fingerprints.mapInArrow(tidy(_filters(bits)), "range int, filter binary")
    return built.groupBy("range").applyInArrow(_merge(bits), "fp long, n long")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, text_md5) for each row; the last one is of the text as it is."""
    scratch = Scratch(df.sparkSession, "exact")
    docs = id_and_text(df, id_col, text_col)
    norm = docs.select("doc_id", F.char_length("text").cast("long").alias("points"), normalised(F.col("text")).alias("norm"), F.md5("text").alias("text_md5"))
    marked = norm.select("doc_id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("digest"), "points", "text_md5", F.monotonically_increasing_id().alias("row"))
    base = scratch.write(marked, "base")
    suspects = scratch.write(repeated_fingerprints(base.select("fp"), base.count()).select("fp"), "suspects")
    small = broadcast_if_small(scratch, suspects, "suspects", BROADCAST_BYTES)
    # byte verification: equal texts meet as keys of an aggregate that combines in each task first
    texts = docs.select(normalised(F.col("text")).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    seen = texts.join(small, "fp", "left_semi").groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("copies"))
    verified = scratch.write(seen.select("fp", F.unhex(F.sha2("norm", 256)).alias("digest"), "copies"), "verified")
    verified = verified.groupBy("digest").agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts have one digest"))).otherwise(F.max("copies")).cast("long").alias("group_size")
    )
    best = F.min(F.struct((-F.col("points")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("best")
    chosen = base.join(small, "fp", "left_semi").groupBy("digest").agg(best).join(verified, "digest")
    classes = scratch.write(chosen.where("group_size > 1").select("digest", F.col("best.doc_id").alias("chosen_id"), F.col("best.row").alias("chosen"), "group_size"), "classes")
    scratch.keep("base", "classes")
    out = base.join(broadcast_if_small(scratch, classes, "classes", BROADCAST_BYTES), "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("chosen_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("chosen"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_md5",
    )
