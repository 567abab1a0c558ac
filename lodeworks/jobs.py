"""Command line (survey A8): one job for each workload, from source files to a sink.

``python -m lodeworks.jobs JOB name=value ...``; ``python -m lodeworks.jobs`` lists the jobs
with their parameters. What a run found out, its seconds, errors, histograms or
leaders, is printed as one JSON line (B11).
"""

from __future__ import annotations

import inspect
import json
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import stats
from lodeworks.functions.scalar import py_round, seconds_text
from lodeworks.operators import cluster, counts, graph, itemsets, partitions, recommend, similarity, sketches
from lodeworks.sources import readers, sinks

JOBS: dict[str, Callable[..., dict]] = {}


def job(f: Callable[..., dict]) -> Callable[..., dict]:
    JOBS[f.__name__] = f
    return f


def _text(spark: SparkSession, text: str, path: str) -> None:
    """One small document as a text file in a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _leaders(df: DataFrame, key: str) -> list:
    return [[r[key], r["n"]] for r in counts.top_k(df, key).collect()]  # ten rows


@job
def review_summary(spark: SparkSession, reviews: str, out: str, year: int = 2018) -> dict:
    """Totals, exact distinct counts and the ten most frequent users and businesses, as JSON (B1)."""
    rows = readers.read_json_lines(spark, reviews, readers.REVIEW)
    found = counts.review_summary(rows, "user_id", "business_id", "date", year).first().asDict()
    found |= {"top10_user": _leaders(rows, "user_id"), "top10_business": _leaders(rows, "business_id")}
    _text(spark, json.dumps(found, ensure_ascii=False), out)
    return found


@job
def partition_layout(spark: SparkSession, reviews: str, out: str, n_partition: int = 8) -> dict:
    """M1-M4: partitions, their sizes and the ten most frequent businesses, as the files are laid out and by a hash of the business."""
    rows = readers.read_json_lines(spark, reviews, readers.REVIEW).select("business_id")
    found = {}
    for name, laid in (("default", rows), ("customized", rows.repartition(n_partition, "business_id"))):
        began = time.perf_counter()
        top = _leaders(laid, "business_id")
        took = round(time.perf_counter() - began, 3)
        sizes = partitions.partition_profile(rows) if name == "default" else partitions.partition_profile(rows, n_partition, "business_id")
        n_items = [r["n_items"] for r in sizes.orderBy("partition_id").collect()]  # a number for each partition
        found[name] = {"n_partition": len(n_items), "n_items": n_items, "exe_time": took, "top10_business": top}
    _text(spark, json.dumps(found, ensure_ascii=False), out)
    return found


@job
def city_stars(spark: SparkSession, reviews: str, businesses: str, out: str, append: bool = False) -> dict:
    """Mean stars of each city, best first, as CSV (B2), and the seconds of taking ten against taking all."""
    stars = readers.read_json_lines(spark, reviews, readers.REVIEW).select("business_id", "stars")
    city = readers.read_json_lines(spark, businesses, readers.BUSINESS).select("business_id", "city")
    means = counts.average_by(stars.join(city, "business_id"), "city", F.col("stars"))
    took = {}
    for name, k in (("all", None), ("ten", 10)):
        began = time.perf_counter()
        counts.ranked(means, "stars", "city", k).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    shown = counts.ranked(means, "stars", "city").select("city", py_round("stars", F.lit(1)).alias("stars"))
    sinks.write_csv(shown, out, mode="append" if append else "overwrite")
    return {"seconds": took, "top10": [list(r) for r in counts.ranked(means, "stars", "city", 10).collect()]}


@job
def state_pairs(spark: SparkSession, reviews: str, businesses: str, out: str, state: str = "NV") -> dict:
    """Reviews of one state's businesses as sorted CSV of user and business (B3); repeated pairs stay."""
    keep = readers.read_json_lines(spark, businesses, readers.BUSINESS).where(F.col("state") == state)
    rows = counts.semi_filter(readers.read_json_lines(spark, reviews, readers.REVIEW).select("user_id", "business_id"), keep, "business_id")
    sinks.write_csv(rows.select("user_id", "business_id").orderBy("user_id", "business_id"), out)
    return {"n_pairs": rows.count()}


@job
def frequent_itemsets(spark: SparkSession, pairs: str, out: str, support: int, larger_than: int = 0, swapped: bool = False) -> dict:
    """Candidates and frequent itemsets of businesses by user, or of users by business, as text."""
    key, item = ("business_id", "user_id") if swapped else ("user_id", "business_id")
    found = itemsets.baskets(readers.read_headered_csv(spark, pairs, readers.PAIR), key, item, larger_than)
    began = time.perf_counter()
    candidates, frequent = itemsets.son(found, support)
    _text(spark, sinks.itemset_report(candidates, frequent), out)
    return {"seconds": round(time.perf_counter() - began, 3)}


@job
def similar_pairs(spark: SparkSession, ratings: str, out: str, least: float = 0.5, exact: bool = False) -> dict:
    """Pairs of businesses with similar raters, sorted by both ids (G4), as CSV."""
    rows = readers.read_headered_csv(spark, ratings, readers.RATING)
    found = (similarity.exact_jaccard if exact else similarity.lsh_jaccard)(rows, "business_id", "user_id", least)
    sinks.write_csv(found.orderBy("a", "b"), out, "business_id_1, business_id_2, similarity")
    return {"n_pairs": found.count()}


@job
def neighbour_order(spark: SparkSession, ratings: str, out: str) -> dict:
    """Businesses that share a MinHash band, with their Pearson similarity, most similar first, as CSV."""
    found = recommend.ranked_neighbours(_known(readers.read_headered_csv(spark, ratings, readers.RATING)))
    sinks.write_csv(found.select("item", "other", "sim"), out, "business_id_1, business_id_2, similarity")
    return {"n_pairs": found.count()}


def _known(rows: DataFrame) -> DataFrame:
    named = rows.select(F.col("user_id").alias("user"), F.col("business_id").alias("item"), F.col("stars").alias("rating"))
    return counts.last_rating(named, "user", "item", "rating")


@job
def predict(spark: SparkSession, train: str, test: str, out: str, case: int = 5) -> dict:
    """Predictions by ALS (1), user CF (2), item CF (3), item CF with LSH (4) or the hybrid (5), as CSV (B5); RMSE and errors are reported."""
    known, asked = (_known(readers.read_headered_csv(spark, path, readers.RATING)) for path in (train, test))
    user_mean, item_mean = known.groupBy("user").agg(F.avg("rating").alias("user_mean")), known.groupBy("item").agg(F.avg("rating").alias("item_mean"))
    ways = {1: recommend.als, 2: recommend.user_cf, 3: recommend.item_cf_first, 4: recommend.item_cf_lsh}
    found = ways[case](asked, known) if case in ways else recommend.hybrid(asked, known, user_mean, item_mean)
    found = found.select("user", "item", "prediction")
    sinks.write_csv(found, out, "user_id, business_id, prediction")
    both = asked.join(found, ["user", "item"])
    return {"rmse": stats.rmse(both, "rating", "prediction").first()["rmse"], "errors": stats.error_histogram(both, "rating", "prediction").first().asDict()}


def _graph(spark: SparkSession, pairs: str, least: int) -> DataFrame:
    return graph.cooccurrence_edges(readers.read_headered_csv(spark, pairs, readers.PAIR), "user_id", "business_id", least)


@job
def communities(spark: SparkSession, pairs: str, out: str, least: int = 7, rounds: int = 5) -> dict:
    """Communities of users by label propagation, as text."""
    found = graph.communities(graph.label_propagation(_graph(spark, pairs, least), rounds))
    sinks.community_lines(found).write.mode("overwrite").text(out)
    return {"n_communities": found.count()}


@job
def girvan_newman(spark: SparkSession, pairs: str, betweenness: str, out: str, least: int = 7) -> dict:
    """Edges by betweenness (B7) and the communities of best modularity (B8), as text."""
    edges = _graph(spark, pairs, least)
    sinks.betweenness_lines(graph.edge_betweenness(edges)).write.mode("overwrite").text(betweenness)
    found, quality = graph.girvan_newman(edges)
    sinks.community_lines(found).write.mode("overwrite").text(out)
    return {"modularity": quality, "n_communities": found.count()}


@job
def clusters(spark: SparkSession, points: str, out: str, k: int, init_multiplier: int = 10, min_cluster: int = 10) -> dict:
    """Rounds and labels of the points as text (B10), and their purity."""
    rows = readers.read_points(spark, points)
    labels, rounds = cluster.bfr(rows.select("index", "features"), k, init_multiplier=init_multiplier, min_cluster=min_cluster)
    sinks.bfr_report(rounds, labels).write.mode("overwrite").text(out)
    return cluster.purity(labels, rows.select("index", "label")).first().asDict()


@job
def bloom_rates(spark: SparkSession, cities: str, out: str) -> dict:
    """False positive rate after each file of JSON lines, as CSV of time and rate (B9, I5); a file's time is its modification."""
    read = spark.read.schema(readers.CITY).json(cities).select("city", F.col("_metadata.file_modification_time").alias("ts"), F.col("_metadata.file_block_start").alias("at"))
    rows = read.withColumn("place", F.monotonically_increasing_id())
    found = sketches.bloom_fpr(rows, "city", ["ts", "at", "place"], F.col("ts"))
    sinks.write_csv(found.orderBy("batch").select(seconds_text(F.col("batch")), "fpr"), out, "Time,FPR")
    return {"n_batches": found.count()}


def _typed(f: Callable, given: dict[str, str]) -> dict:
    """Arguments in the types that the job declares."""
    kinds = {n: p for n, p in inspect.signature(f).parameters.items() if n != "spark"}
    unknown, absent = sorted(set(given) - set(kinds)), [n for n, p in kinds.items() if p.default is p.empty and n not in given]
    if unknown or absent:
        raise SystemExit(f"{f.__name__}: unknown {unknown}, missing {absent}")
    read = {"int": int, "float": float, "bool": lambda x: x.lower() in ("1", "true", "yes"), "str": str}
    return {n: read[kinds[n].annotation](v) for n, v in given.items()}


def main(argv: list[str], spark: SparkSession | None = None) -> dict | None:
    """Run the job named first with the ``name=value`` arguments behind it."""
    if not argv or argv[0] not in JOBS:
        for name, f in sorted(JOBS.items()):
            print(name, *[n if p.default is p.empty else f"[{n}={p.default}]" for n, p in inspect.signature(f).parameters.items() if n != "spark"])
        return None
    chosen = JOBS[argv[0]]
    arguments = _typed(chosen, dict(a.split("=", 1) for a in argv[1:]))
    began = time.perf_counter()
    found = chosen(spark or SparkSession.builder.appName(argv[0]).getOrCreate(), **arguments)
    print(json.dumps({"job": argv[0], "duration": round(time.perf_counter() - began, 3)} | found, ensure_ascii=False, default=str))
    return found


if __name__ == "__main__":
    main(sys.argv[1:])
