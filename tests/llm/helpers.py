"""Documents for the tests, with columns whose names the operators use inside."""

from pyspark.sql import functions as F

CLASHING = ["fp", "digest", "hash", "key", "node", "component", "n", "size", "lost", "lines", "norm", "start", "first", "cell", "unit", "shard", "score", "ids", "kept", "a", "b"]


def documents(spark, rows):
    """(doc_id, text) rows, and columns with clashing names."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def rows_of(df, *columns):
    """Sorted tuples of columns."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
