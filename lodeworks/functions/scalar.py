"""Scalar column expressions (survey I1-I17, C13-C15). All stay inside the JVM but for ``py_round``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Pairs (a, b) of the hash functions ``(a * x + b) % m`` (fixed values).
HASH_PAIRS = [
    (7, 97), (59, 263), (337, 821), (163, 409), (257, 647), (1151, 1697),
    (941, 1151), (443, 1231), (743, 2293), (1571, 727), (3709, 2273), (5101, 23),
    (6947, 1931), (8039, 2789), (773, 6661), (4871, 6709), (9973, 3221), (9001, 9511),
]
SKETCH_PAIRS = HASH_PAIRS[:6]


def year_prefix(date: Column) -> Column:
    """First four characters of a date's text."""
    return F.substring(date.cast("string"), 1, 4)


@F.pandas_udf(DoubleType())
def py_round(values: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding of the exact binary value, half to even on true ties (I2); meant for small grouped results."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(values, digits, strict=True)], dtype="float64")


def clip(rating: Column, low: float = 1.0, high: float = 5.0) -> Column:
    """Rating within its bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), rating))


def zero_default(rating: Column, default: float = 3.0) -> Column:
    """A rating of exactly zero becomes the default (C14)."""
    return F.when(rating == 0, F.lit(default)).otherwise(rating)


def byte_fold(text: Column, modulus: int) -> Column:
    """The UTF-8 bytes of a text, read as one big-endian number, modulo ``modulus`` (I6), without ever making that number."""
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(digits), F.lit(2))
    step = lambda acc, k: (acc * 256 + F.conv(F.substring(digits, k, 2), 16, 10).cast("long")) % modulus
    return F.when(F.length(digits) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(places, F.lit(0).cast("long"), lambda acc, k: step(acc, k)))


def linear_hashes(x: Column, modulus: int, pairs=tuple(SKETCH_PAIRS)) -> Column:
    """Array of ``(a * x + b) % modulus`` for each pair."""
    return F.array(*[F.pmod(F.lit(a) * x + F.lit(b), F.lit(modulus)) for a, b in pairs])


def trailing_zeros(x: Column) -> Column:
    """Zero bits at the low end; none for zero."""
    return F.when(x == 0, F.lit(0)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union of two arrays (I12, H2); null for two empty ones."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def seconds_text(ts: Column) -> Column:
    """A timestamp to whole seconds, as ``2019-01-31 23:59:59``."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value.cast("string"), F.lit("'"))


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many places, halves away from zero, as DuckDB rounds: the product with the power of ten decides what a half is, not the decimal number."""
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)
