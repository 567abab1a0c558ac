"""Graphs (survey J16-J20, E10, E21, E24, F6): co-occurrence, label propagation, components, betweenness, communities."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.similarity import overlaps
from lodeworks.plans.stages import Scratch

#: Edges of a graph whose betweenness is computed from whole adjacency lists, which every task then holds.
MOST_EDGES = 2_000_000


def cooccurrence_edges(rows: DataFrame, node: str, item: str, least: int) -> DataFrame:
    """(src, dst) of nodes that share at least ``least`` items."""
    return overlaps(rows, node, item, least).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label) after synchronous rounds in which every node takes its neighbours' most frequent label, the smallest on ties."""
    scratch = Scratch(edges.sparkSession, "labels")
    links = scratch.write(both_ways(edges), "links")
    labels = links.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    for k in range(rounds):
        seen = links.join(labels, links.dst == labels.node).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = F.min_by("label", F.struct(-F.col("n"), F.col("label")))
        labels = scratch.write(seen.groupBy(F.col("src").alias("node")).agg(best.alias("label")), f"round-{k}")
        scratch.keep("links", f"round-{k}")
    return labels


def communities(labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """(size, members): sorted members of each label, ordered by size and members."""
    groups = labels.groupBy(label).agg(F.array_sort(F.collect_list(node)).alias("members"))
    return groups.select(F.size("members").alias("size"), "members").orderBy("size", "members")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for each node of ``edges`` (src, dst).

    Alternating large stars and small stars: the larger neighbours of a node are
    linked to the smallest node around it, then its smaller neighbours and itself
    to the smallest of these. Both keep components as they are, edges never grow in
    number, and distances to the smallest node about halve in a round, so that a
    path takes a logarithmic number of rounds however its nodes are numbered.
    Minima are combined in each task first, and joins read written tables, so that
    a node with many edges is split by AQE. A null end is no node.
    """
    return star_rounds(edges)[0]


def star_rounds(edges: DataFrame) -> tuple[DataFrame, int]:
    """Components as :func:`connected_components` gives them, and the rounds it took."""
    scratch = Scratch(edges.sparkSession, "components")
    links = scratch.write(_pairs(edges.select(F.col("src").alias("low"), F.col("dst").alias("big")), "low", "big"), "links-0")
    k = 0
    while True:
        k += 1
        up = links.groupBy(F.col("big").alias("low")).agg(F.min("low").alias("top"))
        large = links.join(up, "low", "left").select("big", F.coalesce("top", "low").alias("low"), F.col("top").isNotNull().alias("moved"))
        large = scratch.write(large, f"large-{k}")
        ends = large.groupBy("big").agg(F.min("low").alias("top"), F.max("low").alias("other"), F.max("moved").alias("moved"))
        ends = scratch.write(ends, f"ends-{k}")
        if ends.where("moved or top <> other").isEmpty():
            break
        small = large.join(ends.select("big", "top"), "big").where("low <> top").select(F.col("low").alias("big"), F.col("top").alias("low"))
        links = scratch.write(small.union(ends.select("big", F.col("top").alias("low"))).distinct(), f"links-{k}")
        scratch.drop(f"links-{k - 1}", f"large-{k}", f"ends-{k}")
    roots = ends.select(F.col("top").alias("node"), F.col("top").alias("component")).distinct()
    out = scratch.write(ends.select(F.col("big").alias("node"), F.col("top").alias("component")).union(roots), "out")
    scratch.keep("out")
    return out, k


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Different pairs of different ends, the smaller one first, under the names given."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def modularity(edges: DataFrame, labels: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """One row (modularity) of a partition (node, label).

    Degrees and the number of edges are those of ``edges``; the edges inside communities are counted in
    ``current``, the edges left after removals, where given.
    """
    links = both_ways(edges)
    inside = both_ways(current) if current is not None else links
    m2 = links.agg(F.count(F.lit(1)).alias("m2"))  # one row
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    of = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l_{s}"))
    inner = inside.join(of("src"), "src").join(of("dst"), "dst").where("l_src = l_dst").groupBy(F.col("l_src").alias("label")).agg(F.count(F.lit(1)).alias("inner"))
    total = degree.join(of("src"), "src").groupBy(F.col("l_src").alias("label")).agg(F.sum("k").alias("total"))
    share = total.join(inner, "label", "left").join(F.broadcast(m2))
    q = F.coalesce("inner", F.lit(0)) / F.col("m2") - F.pow(F.col("total") / F.col("m2"), F.lit(2))
    return share.agg(F.sum(q).alias("modularity"))


def _credits(root, adjacency: dict, exact: bool) -> list[tuple]:
    """(u, v, credit) of the shortest-path graph below a root.

    A node's weight among its child's parents is the number of its own parents, or with ``exact`` the number of
    shortest paths to it.
    """
    level, weight, parents, order = {root: 0}, defaultdict(int, {root: 1}), defaultdict(list), [root]
    front = [root]
    while front:
        later = []
        for u in front:
            for v in adjacency[u]:
                if v not in level:
                    level[v] = level[u] + 1
                    later.append(v)
                if level[v] == level[u] + 1:
                    parents[v].append(u)
                    weight[v] += weight[u] if exact else 1
        order += later
        front = later
    credit, out = dict.fromkeys(order, 1.0), []
    for v in reversed(order):
        total = sum(weight[u] for u in parents[v])
        for u in parents[v]:
            part = credit[v] * weight[u] / total
            credit[u] += part
            out.append((*((u, v) if u < v else (v, u)), part))
    return out


def edge_betweenness(edges: DataFrame, exact: bool = False) -> DataFrame:
    """(src, dst, betweenness): credit of each edge over all roots, halved.

    Roots are dealt to tasks; each task holds the adjacency of the whole graph, so graphs of more than
    ``MOST_EDGES`` edges are refused: use :func:`edge_betweenness_frontier` for them.
    """
    pairs = _pairs(edges, "src", "dst")
    known = pairs.limit(MOST_EDGES + 1).collect()
    if len(known) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges: use edge_betweenness_frontier")
    adjacency = defaultdict(list)
    for u, v in known:
        adjacency[u].append(v)
        adjacency[v].append(u)
    sent = edges.sparkSession.sparkContext.broadcast(dict(adjacency))  # bounded by MOST_EDGES
    kind = pairs.schema["src"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            total: dict[tuple, float] = defaultdict(float)
            for root in batch.column(0).to_pylist():
                for u, v, part in _credits(root, sent.value, exact):
                    total[u, v] += part
            if total:
                u, v = zip(*total, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(list(total.values()))], names=["src", "dst", "credit"])

    roots = both_ways(edges).select("src").distinct()
    parts = roots.mapInArrow(run, f"src {kind}, dst {kind}, credit double")
    return parts.groupBy("src", "dst").agg((F.sum("credit") / 2).alias("betweenness"))


def edge_betweenness_frontier(edges: DataFrame, exact: bool = False) -> DataFrame:
    """(src, dst, betweenness) as :func:`edge_betweenness`, by joins alone: one frontier of (root, node) for each level.

    Rows grow with nodes times roots, as the measure itself does, but no task holds the graph.
    """
    scratch = Scratch(edges.sparkSession, "frontier")
    links = scratch.write(both_ways(edges), "links")
    front = scratch.write(links.select(F.col("src").alias("root"), F.col("src").alias("node"), F.lit(1).cast("long").alias("weight")).distinct(), "front-0")
    visited, steps = front.select("root", "node"), []
    while True:
        k = len(steps)
        step = front.select("root", F.col("node").alias("parent"), F.col("weight").alias("pw")).join(links, F.col("parent") == links.src)
        step = step.select("root", "parent", "pw", F.col("dst").alias("node")).join(visited, ["root", "node"], "left_anti")
        step = scratch.write(step, f"step-{k}")
        if step.isEmpty():
            break
        steps.append(step)
        weight = F.sum("pw") if exact else F.count(F.lit(1))
        front = scratch.write(step.groupBy("root", "node").agg(weight.alias("weight")), f"front-{k + 1}")
        visited = scratch.write(visited.union(front.select("root", "node")), f"visited-{k + 1}")
        scratch.drop(f"visited-{k}")
    credit, parts = None, None
    for k in reversed(range(len(steps))):
        totals = steps[k].groupBy("root", "node").agg(F.sum("pw").alias("all"))
        rows = steps[k].join(totals, ["root", "node"])
        rows = rows.join(credit, ["root", "node"], "left") if credit is not None else rows.withColumn("credit", F.lit(None).cast("double"))
        rows = scratch.write(rows.select("root", "parent", "node", ((1 + F.coalesce("credit", F.lit(0.0))) * F.col("pw") / F.col("all")).alias("part")), f"credit-{k}")
        credit = rows.groupBy("root", F.col("parent").alias("node")).agg(F.sum("part").alias("credit"))
        parts = rows if parts is None else parts.union(rows)
    if parts is None:  # no edges
        parts = step.select("parent", "node", F.lit(0.0).alias("part"))
    ends = parts.select(F.least("parent", "node").alias("src"), F.greatest("parent", "node").alias("dst"), "part")
    return ends.groupBy("src", "dst").agg((F.sum("part") / 2).alias("betweenness"))


def top_edge(betweenness: DataFrame) -> DataFrame:
    """The edge of largest betweenness; of equal ones, to 8 digits, the first by its ends."""
    return betweenness.orderBy(F.desc(F.round("betweenness", 8)), "src", "dst").limit(1)


def girvan_newman(edges: DataFrame, original_adjacency: bool = False, margin: float = 0.05, exact: bool = False) -> tuple[DataFrame, float]:
    """Communities (size, members) of best modularity, and that modularity.

    Edges of top betweenness go one at a time; it ends when none is left, or when the number of components has
    grown and modularity lies more than ``margin`` below the best. Edges inside communities are those left, or
    with ``original_adjacency`` those of the start; degrees are those of the start. Betweenness is computed by
    tasks, over roots; only the component that lost an edge is computed anew. Its partitions, of graphs within
    ``MOST_EDGES``, are kept by the driver.
    """
    spark = edges.sparkSession
    start = [tuple(r) for r in _pairs(edges, "src", "dst").limit(MOST_EDGES + 1).collect()]
    if len(start) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges")
    schema = edges.select("src", "dst").schema
    whole = defaultdict(set)
    for u, v in start:
        whole[u].add(v)
        whole[v].add(u)
    now = {u: set(vs) for u, vs in whole.items()}
    m2 = 2 * len(start)

    def reach(root) -> frozenset:
        seen, todo = {root}, [root]
        while todo:
            for v in now[todo.pop()]:
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return frozenset(seen)

    def parts(nodes) -> list[frozenset]:
        out, left = [], set(nodes)
        while left:
            out.append(reach(next(iter(left))))
            left -= out[-1]
        return out

    def quality(groups) -> float:
        inner = whole if original_adjacency else now
        return sum(sum(len(inner[u] & g) for u in g) / m2 - (sum(len(whole[u]) for u in g) / m2) ** 2 for g in groups) if m2 else 0.0

    def measure(groups) -> dict[tuple, float]:
        """Betweenness inside some components: by tasks where they are large, else at once."""
        left = sorted((u, v) for g in groups for u in g for v in now[u] if u < v)
        if len(left) <= 256:
            total: dict[tuple, float] = defaultdict(float)
            for g in groups:
                for root in g:
                    for u, v, part in _credits(root, now, exact):
                        total[u, v] += part / 2
            return total
        found = edge_betweenness(spark.createDataFrame(left, schema), exact)
        return {(r["src"], r["dst"]): r["betweenness"] for r in found.collect()}  # MOST_EDGES at most

    groups = parts(now)
    best, best_quality, score = groups, quality(groups), measure(groups)
    while score:
        u, v = min(score, key=lambda e: (-round(score[e], 8), e))
        now[u].discard(v)
        now[v].discard(u)
        before, old = len(groups), next(g for g in groups if u in g)
        new = parts(old)
        groups = [g for g in groups if g is not old] + new
        score = {e: b for e, b in score.items() if e[0] not in old} | measure(new)
        q = quality(groups)
        if q > best_quality:
            best, best_quality = groups, q
        if before < len(groups) and q < best_quality - margin:
            break
    kind = schema["src"].dataType.simpleString()
    rows = spark.createDataFrame([(len(g), sorted(g)) for g in best], f"size int, members array<{kind}>")
    return rows.orderBy("size", "members"), best_quality
