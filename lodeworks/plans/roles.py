"""Role views: the ratings, baskets, graphs and streams that the queries read out of the star schema's tables.

Ratings are line items with their orders: the user is ``o_custkey``, the item
``l_suppkey``, the rating ``ceil(l_quantity / 10)`` (1 to 5), the date ``l_shipdate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators.counts import last_rating
from lodeworks.plans.stages import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, *hint: str) -> DataFrame:
    """(user, item, rating, date), one row for each line item; ``hint`` is of the join with the orders."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    orders = orders.hint(*hint) if hint else orders
    return items.join(orders, "l_orderkey").select(
        F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item"), F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"), F.col("l_shipdate").alias("date")
    )


def ratings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): one rating for each (user, item), the largest; a tenth of the pairs, by their keys, is for testing."""
    # the orders' files are a fraction of their rows in memory, which a broadcast has on the driver
    known = last_rating(reviews(spark, sf_dir, "merge"), "user", "item", "rating").withColumn("_fold", F.pmod(F.col("user") * 31 + F.col("item"), F.lit(10)))
    known = Scratch(spark, "ratings").write(known, "ratings")  # recommenders read it several times
    return known.where("_fold <> 0").drop("_fold"), known.where("_fold = 0").drop("_fold")


def profiles(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user, user_mean) and (item, item_mean), as a user's and an item's profile have them."""
    return train.groupBy("user").agg(F.avg("rating").alias("user_mean")), train.groupBy("item").agg(F.avg("rating").alias("item_mean"))


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, city): the nation of each supplier."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), F.col("s_nationkey").alias("n_nationkey"))
    return supplier.join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("city")), "n_nationkey").select("item", "city")


def order_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item): brands of the parts of each order."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("p_partkey"))
    return items.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item")), "p_partkey").select("basket", "item")


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_partkey), different ones."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, city, tag, props): the user as a city, the event's type as its tag."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("city"), F.col("event_type").alias("tag"), "props")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, label, features)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("index"), "label", F.col("embedding").cast("array<double>").alias("features"))
