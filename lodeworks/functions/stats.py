"""Aggregate expressions shared by the recommenders (survey E11, E12, E14-E17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson(x: str, y: str) -> Column:
    """Pearson correlation of two columns as an aggregate; 0 for one pair or a constant side.

    Sums instead of ``corr``: that one is null or an error in these cases.
    """
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    cov = n * F.sum(F.col(x) * F.col(y)) - sx * sy
    vx, vy = n * F.sum(F.col(x) * F.col(x)) - sx * sx, n * F.sum(F.col(y) * F.col(y)) - sy * sy
    return F.when(cov == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)), F.lit(0.0)))


def weighted(value: Column, weight: Column) -> Column:
    """Sum of value * weight over the sum of absolute weights, 0 where that sum of products is 0."""
    products = F.sum(value * weight)
    return F.when(products == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(products, F.sum(F.abs(weight))), F.lit(0.0)))


def mean_without(total: Column, count: Column, value: Column) -> Column:
    """Mean of a group less one of its values; null if there is no other."""
    return F.try_divide(total - value, count - 1)


def rmse(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row (rmse)."""
    return df.agg(F.sqrt(F.avg(F.pow(F.col(truth) - F.col(prediction), F.lit(2)))).alias("rmse"))


def error_histogram(df: DataFrame, truth: str, prediction: str, legacy_gap: bool = False) -> DataFrame:
    """One row with the absolute errors in five bins (E12); with ``legacy_gap`` an error of exactly 4 is in none."""
    e = F.abs(F.col(truth) - F.col(prediction))
    bins = {f"from_{k}": F.count_if((e >= k) & (e < k + 1)) for k in range(4)}
    bins["from_4"] = F.count_if(e > 4) if legacy_gap else F.count_if(e >= 4)
    return df.agg(*[c.alias(name) for name, c in bins.items()])
