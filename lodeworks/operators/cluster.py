"""Clustering of points too many to hold: rounds over discard, compressed and retained sets (survey J21-J24, E20, E22, E25, F5, H3, H4).

The points stay a table (index, round, features). The driver holds sufficient
statistics only: a count, a sum and a sum of squares for each cluster. Inside a
round statistics are frozen; they take the round's points in at its end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.plans.stages import Scratch


@dataclass
class Summary:
    """Sufficient statistics of clusters."""

    n: np.ndarray
    total: np.ndarray
    squares: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Summary:
        return cls(np.zeros(0), np.zeros((0, d)), np.zeros((0, d)))

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Mahalanobis distance of each point to each cluster; an axis without deviation is infinite off the centre."""
        centre = self.total / self.n[:, None]
        spread = np.sqrt(np.maximum(self.squares / self.n[:, None] - centre * centre, 0))
        off = points[:, None, :] - centre[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.where(spread > 1e-12, off / spread, np.where(np.abs(off) < 1e-12, 0.0, np.inf))
        return np.sqrt((z * z).sum(axis=2))

    def joined(self, other: Summary) -> Summary:
        return Summary(np.append(self.n, other.n), np.vstack([self.total, other.total]), np.vstack([self.squares, other.squares]))


def statistics(assigned: DataFrame) -> DataFrame:
    """(cluster, axis, n, total, squares) of the points (cluster, features), combined in each task before the shuffle."""
    axis = assigned.select("cluster", F.posexplode("features").alias("axis", "x"))
    return axis.groupBy("cluster", "axis").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


def summarise(assigned: DataFrame, d: int) -> tuple[list[int], Summary]:
    """The same at the driver; a row for each cluster and axis."""
    rows = statistics(assigned).collect()
    ids = sorted({r["cluster"] for r in rows})
    place = {c: k for k, c in enumerate(ids)}
    out = Summary(np.zeros(len(ids)), np.zeros((len(ids), d)), np.zeros((len(ids), d)))
    for r in rows:
        k = place[r["cluster"]]
        out.n[k], out.total[k, r["axis"]], out.squares[k, r["axis"]] = r["n"], r["total"], r["squares"]
    return ids, out


def kmeans(points: DataFrame, k: int, seed: int) -> DataFrame:
    """(index, features, cluster) by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = points.withColumn("_v", array_to_vector("features"))
    model = KMeans(k=max(2, k), seed=seed, featuresCol="_v", predictionCol="cluster", maxIter=20).fit(data)
    return model.transform(data).select("index", "features", "cluster")


def nearest(points: DataFrame, summary: Summary, limit: float) -> DataFrame:
    """The points with the cluster nearest to them (F5), -1 where none is nearer than ``limit``."""
    if not len(summary.n):
        return points.withColumn("cluster", F.lit(-1))
    sent = points.sparkSession.sparkContext.broadcast(summary)  # a few numbers for each cluster

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), dtype=float)
            found = np.full(batch.num_rows, -1, dtype=np.int32)
            for at in range(0, batch.num_rows, 1024):
                far = sent.value.distances(x[at : at + 1024])
                best = far.argmin(axis=1)
                found[at : at + 1024] = np.where(far[np.arange(len(best)), best] < limit, best, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "cluster"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(run, f"{kinds}, cluster int")


def merge_near(summary: Summary, limit: float) -> np.ndarray:
    """For each set the one it is merged into, itself if none: centres against later sets' statistics, first fit, one pass."""
    target, taken = np.arange(len(summary.n)), set()
    for i in range(len(summary.n)):
        if i in taken:
            continue
        centre = (summary.total[i] / summary.n[i])[None]
        far = summary.distances(centre)[0]
        for j in range(i + 1, len(summary.n)):
            if j not in taken and far[j] < limit:
                target[j] = i
                taken |= {i, j}
    return target


def _compressed(retained: DataFrame, ratio: float, seed: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Retained points by k-means with ``ratio`` times their number of clusters: points of clusters of two and more (cluster), and the rest."""
    n = retained.count()
    if n < 2 or int(ratio * n) < 2:
        return retained.withColumn("cluster", F.lit(-1)).where("false"), retained
    rows = scratch.write(kmeans(retained, int(ratio * n), seed), name)
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    rows = scratch.write(rows.join(sizes, "cluster"), f"{name}-sized")
    return rows.where("size > 1").select("index", "features", "cluster"), rows.where("size = 1").select("index", "features")


def bfr(points: DataFrame, k: int, rounds: int = 5, init_multiplier: int = 10, min_cluster: int = 10, ratio: float = 0.6, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(index, cluster) of every point, -1 for outliers, and a row of counts for each round.

    ``points``: (index, features). A point's round follows from a hash of its index. In the first round,
    small clusters of a fine k-means are set aside, and a k-means of the rest makes the discard sets. Later points
    go to the nearest discard set within ``2 * sqrt(d)``, else to the nearest compressed set, else they are
    retained. At the end compressed sets near a discard set join it.
    """
    spark = points.sparkSession
    scratch = Scratch(spark, "bfr")
    data = scratch.write(points.select(F.col("index").cast("long"), F.col("features").cast("array<double>"), (F.pmod(F.xxhash64("index", F.lit(seed)), F.lit(rounds)) + 1).alias("round")), "points")
    head = data.select(F.size("features").alias("d")).first()
    log_schema = "round int, n_discard long, n_compressed_sets long, n_compressed long, n_retained long"
    if head is None:
        return spark.createDataFrame([], "index long, cluster int"), spark.createDataFrame([], log_schema)
    d, limit, log = head["d"], 2 * head["d"] ** 0.5, []
    first = data.where("round = 1").select("index", "features")
    fine = scratch.write(kmeans(first, min(k * init_multiplier, max(2, first.count())), seed), "fine")
    sizes = fine.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    fine = scratch.write(fine.join(sizes, "cluster"), "fine-sized")
    core = fine.where(F.col("size") >= min_cluster).select("index", "features")
    if core.isEmpty():  # nothing is dense enough: all of the first round starts the clusters
        core = first
    retained = scratch.write(first.join(core.select("index"), "index", "left_anti"), "retained-1")
    coarse = scratch.write(kmeans(core, k, seed), "coarse")
    ids, discard = summarise(coarse, d)
    names = {c: j for j, c in enumerate(ids)}
    number = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    labels = scratch.write(coarse.select("index", number[F.col("cluster")].cast("int").alias("cluster")), "labels-1")
    members = data.select("index", "features", F.lit(0).alias("cluster")).where("false")
    compressed = Summary.empty(d)

    def absorb(r: int):
        """Turn retained points into compressed sets, and merge near ones."""
        nonlocal retained, members, compressed
        new, retained_now = _compressed(retained, ratio, seed + r, scratch, f"rs-{r}")
        order, more = summarise(new, d)
        shift = len(compressed.n)
        table = [(c, shift + j) for j, c in enumerate(order)]
        both = compressed.joined(more)
        target = merge_near(both, limit) if r > 1 else np.arange(len(both.n))
        kept = sorted(set(target.tolist()))
        final = {j: kept.index(int(t)) for j, t in enumerate(target)}
        old = members.select("index", "features", F.col("cluster").alias("c"))
        if table:
            codes = spark.createDataFrame(table, "cluster int, c int")  # a row for each compressed set
            old = old.union(new.join(codes, "cluster").select("index", "features", "c"))
        moved = spark.createDataFrame([(j, t) for j, t in final.items()] or [(-1, -1)], "c int, cluster int")
        members = scratch.write(old.join(moved, "c").select("index", "features", "cluster"), f"cs-{r}")
        retained = scratch.write(retained_now.select("index", "features"), f"retained-out-{r}")
        compressed = Summary(*[np.array([sum(v[j] for j in final if final[j] == c) for c in range(len(kept))]).reshape(len(kept), *v.shape[1:]) for v in (both.n, both.total, both.squares)]) if kept else Summary.empty(d)

    def note(r: int) -> None:
        log.append((r, int(discard.n.sum()), len(compressed.n), int(compressed.n.sum()), retained.count()))

    def add(to: Summary, rows: DataFrame) -> None:
        for c, n, s, q in zip(*(lambda i, m: (i, m.n, m.total, m.squares))(*summarise(rows, d)), strict=True):
            to.n[c] += n
            to.total[c] += s
            to.squares[c] += q

    absorb(1)
    note(1)
    for r in range(2, rounds + 1):
        batch = data.where(F.col("round") == r).select("index", "features")
        placed = scratch.write(nearest(batch, discard, limit), f"placed-{r}")
        hits = placed.where("cluster >= 0")
        labels = scratch.write(labels.union(hits.select("index", "cluster")), f"labels-{r}")
        rest = scratch.write(nearest(placed.where("cluster < 0").select("index", "features"), compressed, limit), f"rest-{r}")
        add(discard, hits)
        near = rest.where("cluster >= 0")
        add(compressed, near)
        members = scratch.write(members.union(near.select("index", "features", "cluster")), f"cs-in-{r}")
        retained = scratch.write(retained.union(rest.where("cluster < 0").select("index", "features")), f"retained-in-{r}")
        absorb(r)
        if r == rounds and len(compressed.n):
            far = discard.distances(compressed.total / compressed.n[:, None])
            best = far.argmin(axis=1)
            joins = [(c, int(b)) for c, b in enumerate(best) if far[c, b] < limit]
            table = spark.createDataFrame(joins or [(-1, -1)], "cluster int, target int")
            moved = members.join(table, "cluster").select("index", "features", F.col("target").alias("cluster"))
            labels = scratch.write(labels.union(moved.select("index", "cluster")), "labels-end")
            add(discard, moved)
            left = [c for c in range(len(compressed.n)) if c not in dict(joins)]
            compressed = Summary(compressed.n[left], compressed.total[left], compressed.squares[left])
        note(r)
    out = data.select("index").join(labels, "index", "left").select("index", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return out, spark.createDataFrame(log, log_schema)


def purity(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (n_correct, n_total, purity): points of each cluster's most frequent class, over all points with a class.

    ``labels``: (index, cluster), outliers -1; ``truth``: (index, label).
    """
    table = labels.where("cluster >= 0").join(truth, "index").groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    best = table.groupBy("cluster").agg(F.max("n").alias("best")).agg(F.coalesce(F.sum("best"), F.lit(0)).alias("n_correct"))
    total = truth.agg(F.count(F.lit(1)).alias("n_total"))
    return best.join(F.broadcast(total)).select("n_correct", "n_total", F.try_divide("n_correct", "n_total").alias("purity"))


def sizes(labels: DataFrame, column: str) -> DataFrame:
    """Points of each label."""
    return labels.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


