"""Sources (survey A1-A7): declared schemas, no inference, columns pruned by Catalyst."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType()}
    return T.StructType([T.StructField(k, kinds[v]) for k, v in fields.items()])


REVIEW = _struct(user_id="s", business_id="s", stars="d", date="s")
BUSINESS = _struct(business_id="s", city="s", state="s", stars="d")
USER = _struct(user_id="s", average_stars="d")
PAIR = _struct(user_id="s", business_id="s")
RATING = _struct(user_id="s", business_id="s", stars="d")
CITY = _struct(city="s")
TWEET = T.StructType().add("entities", T.StructType().add("hashtags", T.ArrayType(T.StructType().add("text", T.StringType()))))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema (A1)."""
    return spark.read.schema(schema).json(path)


def read_headered_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with one header line a file; columns by position, so the header's own names do not matter (A2)."""
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``index,label,x1..xd`` without header as (index, label, features) (A3)."""
    parts = F.split("value", ",")
    return spark.read.text(path).where(F.trim("value") != "").select(
        parts[0].cast("long").alias("index"), parts[1].cast("int").alias("label"), F.slice(parts, 3, F.size(parts)).cast("array<double>").alias("features")
    )


def socket_lines(spark: SparkSession, port: int, host: str = "localhost") -> DataFrame:
    """Unbounded lines of text from a TCP server (A4)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_lines(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Unbounded lines of the text files that arrive in a folder: the replayable stand-in for a socket."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def decode_json(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Fields of JSON text, batch or stream (A5); undecodable lines give nulls."""
    return lines.withColumn("_json", F.from_json(F.col(column), schema)).select(*[c for c in lines.columns if c != column], "_json.*")


def track(df: DataFrame, column: str, keywords: Iterable[str]) -> DataFrame:
    """Rows whose text holds any keyword, whatever its case."""
    pattern = "|".join(f"\\Q{k}\\E" for k in keywords)
    return df.where(F.col(column).rlike(f"(?i){pattern}"))


def from_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A driver's collection as a DataFrame."""
    return spark.createDataFrame(rows, schema)
