"""Embedding near duplicates by an inverted multi-index (operator 5).

Unit vectors are cut into halves, and each half has a codebook of its own, fitted
on a bounded sample; a pair of code words is a cell of the product grid. Every
vector is a member of the cell of its nearest code words. As a query it visits
cells in ascending order of distance, in a multi-sequence traversal: a queue holds
the frontier of pairs over both sorted lists of code words. How many cells suffice
for the target recall is measured before: sample vectors are moved to exactly the
limiting cosine in random directions, and the ranks of the cells they fall in are
counted. Every query visits that many cells, and what it meets there is verified
by cosine in double precision.

Equal vectors are one node with a weight. Cells are cut into blocks of members of
a bounded size, past which queries flow. A block counts each query's links, and
those of its members whose own visits leave the query's cell out, so that a pair
that either of the two finds counts once at both ends. It sends one edge for each
query and a spanning forest of its members, so that no list of pairs is ever made:
in a group of n near copies the comparisons grow with n * n, what is sent does not.

The driver fits on a bounded sample, in blocks, so that its memory does not follow
the corpus: at ``MOST_WORDS`` code words a half has 16 million cells; past four
billion vectors cells have more than ``CELL_MEMBERS`` members and more blocks.

Only vectors of one length have a cosine. Each length that more than ``FEW`` vectors
have gets an index of its own; shorter lists are compared whole, a list a task.

Edge cases: vectors that are null, zero, or hold null or non-finite components link
with nothing, nor do rows with a null id (their component is null, and they are
kept); vectors are scaled before they are normed, so that no finite component is too
large or too small; repeated rows are equal vectors and link with each other; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import Scratch, arrow_schema, broadcast_if_small
from lodeworks.llm.components import connected_components

COSINE = 0.95
#: Vectors that codebooks and the number of cells to visit are fitted on.
SAMPLE = 8192
TARGET_RECALL = 0.999
#: Members that a cell is made for, most code words of a half, and members of a block.
CELL_MEMBERS, MOST_WORDS, BLOCK = 256, 4096, 512
#: Vectors of one length that are compared without an index.
FEW = 2048
BROADCAST_BYTES = 8 << 20


def code_words(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Code words of the rows of ``x`` by Lloyd's rounds, from a fixed start."""
    words = x[np.random.default_rng(11).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([squared(x[at : at + 512], words).argmin(axis=1) for at in range(0, len(x), 512)])
        for w in range(len(words)):
            own = x[near == w]
            if len(own):
                words[w] = own.mean(axis=0)
    return words


def squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1)


def traversal(first: np.ndarray, second: np.ndarray, cells: int) -> list[int]:
    """Cells of the grid in ascending order of the sum of their two distances, the nearest ``cells`` of them."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    first, second = first.tolist(), second.tolist()
    n, m = len(a), len(b)
    queue, out, reached = [(first[a[0]] + second[b[0]], 0, 0)], [], [0] * n
    while queue and len(out) < cells:
        _, i, j = heapq.heappop(queue)
        out.append(a[i] * m + b[j])
        reached[i] = j + 1
        # a pair enters when both pairs before it, in its row and its column, have left
        if j + 1 < m and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(queue, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if i + 1 < n and reached[i + 1] == j:
            heapq.heappush(queue, (first[a[i + 1]] + second[b[j]], i + 1, j))
    return out


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray, cells: int):
        self.first, self.second, self.cells = first, second, cells

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return squared(unit[:, :half], self.first), squared(unit[:, half:], self.second)

    def place(self, unit: np.ndarray) -> np.ndarray:
        d, e = self.distances(unit)
        return d.argmin(axis=1) * len(self.second) + e.argmin(axis=1)

    @classmethod
    def fit(cls, sample: np.ndarray, vectors: int, cosine: float = COSINE, recall: float = TARGET_RECALL) -> MultiIndex:
        k = int(np.clip(round((vectors / CELL_MEMBERS) ** 0.5), 2, min(MOST_WORDS, max(2, len(sample)))))
        half = max(1, sample.shape[1] // 2)
        index = cls(code_words(sample[:, :half], k), code_words(sample[:, half:], k), 1)
        queries = sample[:1024]
        noise = np.random.default_rng(7).standard_normal(queries.shape)
        noise -= (noise * queries).sum(axis=1)[:, None] * queries
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        homes = index.place(cosine * queries + (1 - cosine * cosine) ** 0.5 * noise)
        d, e = index.distances(queries)
        row = np.arange(len(queries))
        own = d[row, homes // len(index.second)] + e[row, homes % len(index.second)]
        # cells nearer than the own one, counted from one sorted list for each word of the other half
        ranks = [np.searchsorted(np.sort(e[q]), own[q] - d[q], "left").sum() for q in row]
        index.cells = int(np.quantile(ranks, recall, method="higher")) + 1
        return index


def units(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1)[:, None]
    return raw / np.linalg.norm(raw, axis=1)[:, None]


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the first one that the pairs (a, b) of places join it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[root])
        if (root == was).all():
            return root


def _placed(index, width: int, dtype: str):
    kind = arrow_schema(T.StructType([T.StructField("node", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("cell", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)
                unit = units(raw)
                d, e = index.value.distances(unit)
                cells = d.argmin(axis=1) * e.shape[1] + e.argmin(axis=1)
                visits = [traversal(d[k], e[k], index.value.cells) for k in range(len(unit))]
                columns = [part.column("node"), part.column("weight"), [v.tobytes() for v in raw], cells.astype(np.int32), visits]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return run


def _links(width: int, dtype: str, cosine: float):
    """Rows sorted by (cell, block, query): members first, then the queries that pass them."""
    kind = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    class Block:
        def __init__(self, key):
            self.key, self.parts, self.unit, self.joined = key, [], None, []

        def member(self, node, weight, unit, visits):
            self.parts.append((node, weight, unit, visits))

        def query(self, node, weight, unit, home):
            if self.unit is None:
                if not self.parts:
                    return None
                self.node, self.weight, self.unit, self.visits = (np.concatenate(x) for x in zip(*self.parts, strict=True))
                self.links = np.zeros(len(self.node), dtype=np.int64)
            linked = (unit @ self.unit.T >= cosine) & (node[:, None] != self.node)
            some = linked.any(axis=1)
            if not some.any():
                return None
            linked, node, weight, home = linked[some], node[some], weight[some], home[some]
            for h in np.unique(home):  # members that do not visit the query's cell: the pair is met here only
                missed = ~(self.visits == h).any(axis=1)
                self.links[missed] += weight[home == h] @ linked[home == h][:, missed]
            first = linked.argmax(axis=1)
            row, col = np.nonzero(linked)
            self.joined.append(np.unique(first[row] * len(self.node) + col))
            return node, linked @ self.weight, self.node[first]

        def members(self):
            """Links of the members that only queries found, and an edge from each to the first member it is joined with."""
            if not self.joined:
                return None
            a, b = np.divmod(np.unique(np.concatenate(self.joined)), len(self.node))
            root = joined(a, b, len(self.node))
            told = (root != np.arange(len(root))) | (self.links > 0)
            return self.node[told], self.links[told], self.node[root[told]]

    def run(batches):
        block = None

        def rows(x):
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in x], schema=kind)

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cell, number, query, node, weight, home = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "query", "node", "weight", "home"))
                unit = units(np.frombuffer(b"".join(part.column("vector").to_pylist()), dtype=dtype).reshape(-1, width))
                cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                    if block is None or block.key != (cell[lo], number[lo]):
                        if block is not None and (x := block.members()):
                            yield rows(x)
                        block = Block((cell[lo], number[lo]))
                    if not query[lo]:
                        visits = part.column("visits").slice(lo, hi - lo)
                        block.member(node[lo:hi], weight[lo:hi], unit[lo:hi], visits.flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1))
                    elif x := block.query(node[lo:hi], weight[lo:hi], unit[lo:hi], home[lo:hi]):
                        yield rows(x)
        if block is not None and (x := block.members()):
            yield rows(x)

    return run


def _whole(dtype: str, cosine: float):
    """Links of a list of vectors of one length, all compared with all, a piece of rows at a time."""

    def one(key, table):
        node, weight = (table.column(c).to_numpy() for c in ("node", "weight"))
        unit = units(np.stack([np.frombuffer(v, dtype=dtype) for v in table.column("vector").to_pylist()]))
        links, a, b = np.zeros(len(node), dtype=np.int64), [], []
        for at in range(0, len(node), 256):
            linked = unit[at : at + 256] @ unit.T >= cosine
            linked[np.arange(len(linked)), np.arange(at, at + len(linked))] = False
            links[at : at + 256] = linked @ weight
            x, y = np.nonzero(linked)
            root = joined(x + at, y, len(node)) if len(x) else np.arange(len(node))
            a.append(np.flatnonzero(root != np.arange(len(node))))
            b.append(root[a[-1]])
        root = joined(np.concatenate(a), np.concatenate(b), len(node))
        return pa.table({"node": pa.array(node), "links": pa.array(links), "to": pa.array(node[root])})

    return one


def _indexed(scratch: Scratch, nodes: DataFrame, width: int, total: int, dtype: str, cosine: float, recall: float) -> DataFrame:
    """(node, links, to) of the vectors of one length."""
    spark, name = nodes.sparkSession, f"{width}-"
    own_nodes = nodes.where(F.col("width") == width)
    share = min(1.0, 2 * SAMPLE / total)
    picked = own_nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy(F.xxhash64("node")).limit(SAMPLE)
    picked = [r["vector"] for r in picked.select("vector").collect()]
    index = MultiIndex.fit(units(np.array(picked, dtype=np.float64)), total, cosine, recall)
    sent = spark.sparkContext.broadcast(index)  # 2 * MOST_WORDS code words at most
    placed = own_nodes.select("node", "weight", "vector").repartition("node").mapInArrow(_placed(sent, width, dtype), "node long, weight long, vector binary, cell int, visits array<int>")
    placed = scratch.write(placed, name + "placed")
    cells = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cells = broadcast_if_small(scratch, scratch.write(cells, name + "cells"), name + "cells", BROADCAST_BYTES)
    columns = "cell", "block", "query", "node", "weight", "vector", "home", "visits"
    own = placed.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("query", F.lit(False)).withColumn("home", F.col("cell"))
    visits = placed.select(F.explode("visits").alias("cell"), "node", "weight", "vector", F.col("cell").alias("home")).join(cells, "cell")
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(True)).withColumn("visits", F.lit(None).cast("array<int>"))
    met = own.select(*columns).unionByName(visits.select(*columns)).repartition("cell", "block").sortWithinPartitions("cell", "block", "query")
    return scratch.write(met.mapInArrow(_links(width, dtype, cosine), "node long, links long, to long"), name + "met")


def near_vectors(df: DataFrame, cosine: float = COSINE, recall: float = TARGET_RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    scratch = Scratch(df.sparkSession, "vectors")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    kind = rows.schema["vector"].dataType.elementType
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        rows, kind = rows.withColumn("vector", F.col("vector").cast("array<double>")), T.DoubleType()
    double = isinstance(kind, T.DoubleType)
    dtype = "<f8" if double else "<f4"
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    sound = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    nodes = rows.where(sound).groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.max(F.size("vector")).alias("width"))
    nodes = scratch.write(nodes, "nodes")
    sizes = scratch.write(nodes.groupBy("width").agg(F.count(F.lit(1)).alias("n")), "widths")
    met = [_indexed(scratch, nodes, r["width"], r["n"], dtype, cosine, recall) for r in sizes.where(F.col("n") > FEW).orderBy("width").collect()]  # lengths that many vectors have
    few = sizes.where((F.col("n") > 1) & (F.col("n") <= FEW))
    if not few.isEmpty():
        lists = nodes.join(few.select("width"), "width").select("width", "node", "weight", "vector").mapInArrow(_packed(dtype), "width int, node long, weight long, vector binary")
        met.append(scratch.write(lists.groupBy("width").applyInArrow(_whole(dtype, cosine), "node long, links long, to long"), "met-few"))
    classes = nodes
    if met:
        every = met[0]
        for more in met[1:]:
            every = every.union(more)
        parts = connected_components(every.select(F.col("node").alias("a"), F.col("to").alias("b")))
        classes = classes.join(every.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(parts, "node", "left")
    else:
        classes = classes.withColumn("links", F.lit(None).cast("long")).withColumn("component", F.lit(None).cast("long"))
    classes = classes.select("vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    classes = scratch.write(classes, "classes")
    scratch.keep("classes")
    key = F.when(sound, F.col("vector"))
    out = rows.select("vec_id", key.alias("vector")).join(classes, "vector", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _packed(dtype: str):
    """Vectors as their bytes."""

    def run(batches):
        for batch in batches:
            vectors = [np.array(v, dtype=dtype).tobytes() for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), batch.column(1), batch.column(2), pa.array(vectors, pa.binary())], names=["width", "node", "weight", "vector"])

    return run
