"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.plans import stages
from lodeworks.plans.stages import broadcast_if_small

__all__ = ["Scratch", "arrow_schema", "broadcast_if_small", "by_range", "gathered", "id_and_text", "map_rows", "settled", "small_batches", "tidy", "within"]

#: Most rows and bytes of an Arrow batch of texts. Both sides of the socket hold a batch several times over.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, jobs of the session send Python at most ``SMALL`` at once; then its own settings hold again."""
    own = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch(stages.Scratch):
    """Written tables, made in small batches."""

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with small_batches(self.spark):
            return super().write(df, name)


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table: its last step runs now, in small batches, and not with the settings of whoever reads it."""
    return Scratch(df.sparkSession, label).write(df, "result")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that no other column of the input can clash; a null text becomes the empty one."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, but that a worker, which Spark keeps for further tasks, gives back what a task has freed."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the C library of Linux has it
            if trim is not None:
                trim(0)

    return tidied


def map_rows(
    df: DataFrame,
    start: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: T.StructType,
    rows: int = 512,
) -> DataFrame:
    """``mapInArrow`` in slices of ``rows`` rows, so that what a task holds does not follow the size of Arrow's batches.

    ``start`` runs once a task and returns the function from columns to columns.
    """
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = each({name: part.column(k).to_pylist() for k, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kind], schema=kind)

    return df.mapInArrow(tidy(run), schema)


def within(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at or below ``value``."""
    out = F.lit(0)
    for cut in cuts:
        out = out + (value >= F.lit(cut)).cast("int")
    return out


def gathered(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The first column's longs as unsigned arrays of about ``most`` values, so that a task's memory does not follow its input."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n >= most:
            yield np.concatenate(held).view(np.uint64)
            held, n = [], 0
    if n:
        yield np.concatenate(held).view(np.uint64)


def by_range(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of ``values``, ascending by their upper ``bits`` bits, that have these bits in common."""
    ranges = (values >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(ranges, prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(values)], strict=True):
        yield int(ranges[lo]), values[lo:hi]
