"""Sketches over ordered events, in closed form over whole tables (survey J25-J27, E19, I6-I10, K2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.scalar import byte_fold, linear_hashes, trailing_zeros

BLOOM_BITS, FM_MODULUS = 200, 512


def bloom_fpr(events: DataFrame, value: str, order: list[str], batch: Column) -> DataFrame:
    """(batch, fp, tn, fpr): cumulative false positives of a Bloom filter that meets the events in order.

    An event is a true negative if it sets a bit, that is, if it is the first event with one of its bits, and a
    false positive if it does not although its value is new. Only the first event of a value can be either, so
    the filter's whole history follows from the first event of each value and the first of each bit.
    """
    key = F.struct(*order)
    rows = events.where(F.col(value).isNotNull()).select(F.col(value).cast("string").alias("value"), key.alias("key"), batch.alias("batch"))
    first = rows.groupBy("value").agg(F.min("key").alias("key"), F.min_by("batch", "key").alias("batch"))
    hashed = first.withColumn("bit", F.explode(F.array_distinct(linear_hashes(byte_fold(F.col("value"), BLOOM_BITS), BLOOM_BITS))))
    setters = hashed.groupBy("bit").agg(F.min("key").alias("key")).select("key").distinct()  # BLOOM_BITS rows at most
    marked = first.join(F.broadcast(setters.withColumn("sets", F.lit(1))), "key", "left")
    new = marked.groupBy("batch").agg(F.count("sets").alias("tn"), F.count_if(F.col("sets").isNull()).alias("fp"))
    batches = rows.select("batch").distinct().join(new, "batch", "left")
    from pyspark.sql import Window

    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each batch
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(so_far)
    out = batches.select("batch", total("fp").alias("fp"), total("tn").alias("tn"))
    return out.withColumn("fpr", F.coalesce(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0)))


def fm_maxima(value: Column) -> list[Column]:
    """Aggregates: most trailing zeros for each of the hash functions."""
    hashes = linear_hashes(byte_fold(value, FM_MODULUS), FM_MODULUS)
    return [F.max(trailing_zeros(hashes[k])).alias(f"z{k}") for k in range(6)]


def fm_estimate(maxima: list[Column]) -> Column:
    """Mean of 2 to the power of the maxima, truncated."""
    powers = [F.pow(F.lit(2.0), z) for z in maxima]
    return F.floor(sum(powers[1:], powers[0]) / len(powers)).cast("long")


def fm_windows(events: DataFrame, ts: str, value: str, length: str = "30 seconds", slide: str = "10 seconds", fill: bool = False) -> DataFrame:
    """(window_start, n_distinct, estimate): exact and estimated different values of each sliding window.

    Each different value is hashed once, and values are made different inside a window before they are counted.
    With ``fill`` a window without events, between the first and the last one with any, has the values of the
    window before it; else it has no row.
    """
    named = events.where(F.col(value).isNotNull()).select(F.window(ts, length, slide)["start"].alias("window_start"), F.col(value).cast("string").alias("value")).distinct()
    hashes = linear_hashes(byte_fold(F.col("value"), FM_MODULUS), FM_MODULUS)
    known = named.select("value").distinct().select("value", *[trailing_zeros(hashes[k]).alias(f"t{k}") for k in range(6)])
    sums = named.join(known, "value").groupBy("window_start").agg(F.count(F.lit(1)).alias("n_distinct"), *[F.max(f"t{k}").alias(f"z{k}") for k in range(6)])
    found = sums.select("window_start", "n_distinct", fm_estimate([F.col(f"z{k}") for k in range(6)]).alias("estimate"))
    if not fill:
        return found
    from pyspark.sql import Window

    span = found.agg(F.min("window_start").alias("low"), F.max("window_start").alias("high")).where("low is not null")
    every = span.select(F.explode(F.sequence("low", "high", F.expr(f"INTERVAL {slide}"))).alias("window_start"))
    so_far = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each window
    last = lambda c: F.last(c, ignorenulls=True).over(so_far).alias(c)
    return every.join(found, "window_start", "left").select("window_start", last("n_distinct"), last("estimate"))


def reservoir(df: DataFrame, key: str, size: int = 100, seed: str = "0") -> DataFrame:
    """``size`` rows, each set of rows of that size as likely as any other: those with the smallest hash of key and seed."""
    return df.orderBy(F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(seed))), key).limit(size)
