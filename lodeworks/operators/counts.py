"""Counts, distinct counts, top-k, averages and keyed joins (survey C, D, E, F, G; J1, J2, J5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.scalar import year_prefix
from lodeworks.plans.stages import Scratch


def counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows of each key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def top_k(df: DataFrame, key: str, k: int = 10, name: str = "n") -> DataFrame:
    """The k most frequent keys, ties by key (G1)."""
    return counts(df, key, name).orderBy(F.desc(name), key).limit(k)


def review_summary(reviews: DataFrame, user: str, item: str, date: str, year: int) -> DataFrame:
    """One row of totals, those of a year, and exact distinct counts."""
    return reviews.agg(
        F.count(F.lit(1)).alias("n_review"),
        F.count_if(year_prefix(F.col(date)) == str(year)).alias("n_review_year"),
        F.countDistinct(user).alias("n_user"),
        F.countDistinct(item).alias("n_business"),
    )


def average_by(df: DataFrame, key: str, value: Column, name: str = "stars") -> DataFrame:
    """Mean of a value, truncated to a whole number first, for each key."""
    return df.groupBy(key).agg(F.avg(value.cast("int")).alias(name))


def ranked(df: DataFrame, value: str, key: str, k: int | None = None) -> DataFrame:
    """Rows by value, largest first, then key: all (G2), or the first k."""
    out = df.orderBy(F.desc(value), key)
    return out if k is None else out.limit(k)


def semi_filter(df: DataFrame, keep: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among those of ``keep``; multiplicity stays."""
    return df.join(keep.select(on), on, "left_semi")


def dense_top(df: DataFrame, key: str, k: int = 3) -> DataFrame:
    """Keys with one of the k largest counts, all ties included."""
    n = counts(df, key)
    best = n.select("n").distinct().orderBy(F.desc("n")).limit(k)  # k rows
    rank = best.select("n", F.row_number().over(Window.orderBy(F.desc("n"))).alias("rank"))
    return n.join(F.broadcast(rank), "n").select(key, "n", "rank")


def ordinals(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """(key, ordinal): rank of each different key in sorted order, from 0.

    Keys are cut into ranges by the borders of a bounded sample, ranked inside a
    range, and shifted by the counts of the ranges before: no task sorts all keys.
    The keys are written first and the counts, one for each range, go into the plan:
    a plan that joined the ranges to counts of itself failed on larger tables.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    keys = Scratch(df.sparkSession, "ordinals").write(keys, "keys")
    sample = sorted(r[0] for r in keys.orderBy(F.xxhash64(key), key).limit(2048).collect())
    borders = sample[:: max(1, len(sample) // 64)][1:]
    part = F.lit(0)
    if borders:
        part = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b <= F.col(key)))
    placed = keys.withColumn("_part", part)
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    before = [sum(n for q, n in sizes.items() if q < p) for p in range(len(borders) + 1)]
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    shift = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_part") + 1)
    return placed.withColumn("_k", inside).select(key, (F.col("_k") + shift).cast("long").alias(name))


def last_rating(df: DataFrame, user: str, item: str, rating: str, order: str | None = None) -> DataFrame:
    """One rating for each (user, item): the latest where an order exists, of several at that time the largest, else the largest."""
    pick = F.max_by(rating, F.struct(order, rating)) if order else F.max(rating)
    return df.groupBy(user, item).agg(pick.alias(rating))
