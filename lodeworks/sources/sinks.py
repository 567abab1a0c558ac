"""Sinks (survey B1-B10): results as text rows, and writers for them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.scalar import quoted


def json_document(df: DataFrame, indent: int = 4) -> str:
    """The only row of a small summary as one JSON document, keys in column order (B1)."""
    row = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).first()
    return json.dumps(json.loads(row["j"]), indent=indent, ensure_ascii=False)


def write_csv(df: DataFrame, path: str, header: str | None = None, mode: str = "overwrite", legacy_unquoted: bool = False) -> None:
    """Headered CSV (B2-B5). ``header`` renames the columns, as in ``"user_id, business_id, prediction"``.

    ``legacy_unquoted`` writes fields as they are, so that one with a comma falls into two.
    """
    names = header.split(",") if header else df.columns
    out = df.toDF(*names)
    if not legacy_unquoted:
        out.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
        return
    lines = df.select(F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))
    head = df.sparkSession.createDataFrame([(",".join(names),)], "value string")
    head.coalesce(1).union(lines).write.mode(mode).text(path)


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """(size, line): the sorted itemsets of each size as ``('a', 'b'),('a', 'c')``, a single item as ``('a')``."""
    text = F.concat(F.lit("("), F.array_join(F.transform("items", quoted), ", "), F.lit(")"))
    sets = itemsets.select(F.size("items").alias("size"), F.col("items").cast("array<string>").alias("items"), text.alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("items", "text")))
    return sets.groupBy("size").agg(F.array_join(F.transform(listed, lambda x: x["text"]), ",").alias("line"))


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> str:
    """Both sections, sizes parted by empty lines; the lines are few and come to the driver."""
    body = lambda df: "\n\n".join(r["line"] for r in itemset_lines(df).orderBy("size").collect())
    return f"Candidates:\n{body(candidates)}\n\nFrequent Itemsets:\n{body(frequent)}"


def betweenness_lines(edges: DataFrame) -> DataFrame:
    """``('u', 'v'), value`` for each edge, best first."""
    line = F.concat(F.lit("("), quoted(F.col("src")), F.lit(", "), quoted(F.col("dst")), F.lit("), "), F.col("betweenness").cast("string"))
    return edges.orderBy(F.desc("betweenness"), "src", "dst").select(line.alias("value"))


def community_lines(communities: DataFrame) -> DataFrame:
    """``'a', 'b'`` for each community of a column ``members``, ordered by size and members."""
    return communities.orderBy(F.size("members"), "members").select(F.array_join(F.transform("members", quoted), ", ").alias("value"))


def bfr_report(rounds: DataFrame, labels: DataFrame) -> DataFrame:
    """Lines of a clustering run: one for each round, then one for each point."""
    head = rounds.select(F.col("round").cast("long").alias("k"), F.lit(0).alias("part"), F.format_string("Round %d: %d,%d,%d,%d", "round", "n_discard", "n_compressed_sets", "n_compressed", "n_retained").alias("value"))
    body = labels.select(F.col("index").alias("k"), F.lit(1).alias("part"), F.format_string("%d,%d", "index", "cluster").alias("value"))
    return head.union(body).orderBy("part", "k").select("value")


def append_batch(path: str):
    """A ``foreachBatch`` function that appends each batch's rows as CSV (B9). A replayed batch overwrites its own folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").option("header", True).csv(f"{path}/batch={batch_id}")

    return write
