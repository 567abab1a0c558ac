"""Connected components of pairs (a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators import graph


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of each node of ``pairs`` (a, b: long); component: smallest node reachable."""
    return graph.connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
