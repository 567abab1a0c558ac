"""Physical layout (survey M1-M3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_profile(df: DataFrame, partitions: int | None = None, key: str | None = None) -> DataFrame:
    """(partition_id, n_items) for every partition, empty ones too; laid out by hash of ``key`` first, if given."""
    laid = df.repartition(partitions, key) if partitions and key else df
    n = partitions if partitions and key else laid.rdd.getNumPartitions()
    found = laid.select(F.spark_partition_id().alias("partition_id")).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n_items"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition_id"))
    return every.join(found, "partition_id", "left").select("partition_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def partitions_of_key(df: DataFrame, partitions: int, key: str) -> DataFrame:
    """(key, n_partitions): in how many partitions each key lies after :func:`partition_profile`'s layout; always 1."""
    laid = df.repartition(partitions, key).select(key, F.spark_partition_id().alias("p"))
    return laid.groupBy(key).agg(F.countDistinct("p").alias("n_partitions"))
