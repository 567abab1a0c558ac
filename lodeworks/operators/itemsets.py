"""Frequent itemsets (survey J3, J4, D10, E6-E9, C6-C8, E23)."""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.plans.stages import Scratch

#: Largest table of candidate itemsets, in bytes, that every task holds; a larger one is joined by shuffle.
BROADCAST_BYTES = 4 << 20
#: Baskets in which an itemset has to be found in a part, at least, to be a candidate: below that nearly all subsets would be.
LEAST_LOCAL = 4
#: Subsets of baskets that are looked up at once, and items of baskets, at least, that a recount takes together.
CELLS, RECOUNTED = 1 << 18, 1 << 19


def baskets(df: DataFrame, key: str, item: str, larger_than: int = 0) -> DataFrame:
    """(key, items): the different items of each key, sorted; keys with more than ``larger_than`` of them.

    Swapping ``key`` and ``item`` gives the other orientation.
    """
    return df.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items")).where(F.size("items") > larger_than)


def frequent_itemsets(found: DataFrame, support: int, largest: int | None = None) -> DataFrame:
    """(items, n) of all itemsets in at least ``support`` of the baskets (items), by FP-growth (J4); with ``largest`` those of at most that many items."""
    from pyspark.ml.fpm import FPGrowth

    found = found.select("items").persist()
    try:
        total = found.count()
        if total == 0 or support > total:
            return found.sparkSession.createDataFrame([], found.schema).selectExpr("items", "0L AS n")
        # half an item below the support, so that rounding cannot lift the threshold over it
        model = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / total), minConfidence=1.0).fit(found)
        sets = model.freqItemsets if largest is None else model.freqItemsets.where(F.size("items") <= largest)
        return sets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
    finally:
        found.unpersist()


def frequent_of_size(found: DataFrame, size: int, support: int) -> DataFrame:
    """(items, n) of one size, level by level: frequent sets of size - 1 are joined to baskets, and only their extensions counted."""
    exploded = found.select(F.monotonically_increasing_id().alias("basket"), "items")
    scratch = Scratch(found.sparkSession, "itemsets")
    rows = scratch.write(exploded.select("basket", F.explode("items").alias("item")), "rows")
    singles = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    level = scratch.write(singles.select(F.array("item").alias("items"), "n"), "level-1")
    rows = scratch.write(rows.join(singles.select("item"), "item", "left_semi"), "frequent-rows")
    inside = scratch.write(rows.select("basket", F.array("item").alias("items")), "inside-1")
    for k in range(2, size + 1):
        grown = inside.join(rows, "basket").where(F.col("item") > F.element_at("items", -1))
        grown = scratch.write(grown.select("basket", F.concat("items", F.array("item")).alias("items")), f"grown-{k}")
        level = scratch.write(grown.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support), f"level-{k}")
        if k < size:
            inside = scratch.write(grown.join(level.select("items"), "items", "left_semi"), f"inside-{k}")
        scratch.drop(f"inside-{k - 1}")
    return level


class Part:
    """Baskets of a part as the places of their items among the given, sorted ones; those of a width together."""

    def __init__(self, baskets: list[frozenset], items: list):
        self.rank = {x: k for k, x in enumerate(items)}
        by_width: dict[int, list] = {}
        for b in baskets:
            own = sorted(self.rank[x] for x in b if x in self.rank)
            by_width.setdefault(len(own), []).append(own)
        self.rows = {width: np.array(rows, np.int64) for width, rows in by_width.items()}

    def _narrowed(self, keep: np.ndarray, size: int):
        """(width, rows): baskets with ``size`` or more of the items to keep, which are numbered anew."""
        anew = np.cumsum(keep) - 1
        for width, rows in self.rows.items():
            if width >= size:
                held = keep[rows]
                n = held.sum(1)
                for w in np.unique(n[n >= size]).tolist():
                    yield w, anew[rows[n == w][held[n == w]]].reshape(-1, w)

    def holding(self, candidates: list[tuple]) -> Counter:
        """Baskets that hold each of the candidates, sorted tuples of one size: by the basket's own subsets, or by trying the candidates, whichever are fewer.

        Subsets are looked up as numbers, unless numbers of 62 bits are too short for them.
        """
        if not candidates:
            return Counter()
        size = len(candidates[0])
        wanted = np.array([[self.rank[x] for x in c] for c in candidates], np.int64)
        keep = np.zeros(len(self.rank), bool)
        keep[wanted.ravel()] = True
        wanted, base = (np.cumsum(keep) - 1)[wanted], int(keep.sum())
        counts = np.zeros(len(candidates), np.int64)
        numbered = base**size < 1 << 62
        if numbered:
            digits = np.array([base**k for k in range(size - 1, -1, -1)], np.int64)
            numbers = wanted @ digits
            order = np.argsort(numbers)
            numbers = numbers[order]
        else:
            place = {tuple(c): k for k, c in enumerate(wanted.tolist())}
        for width, rows in self._narrowed(keep, size):
            if comb(width, size) > len(candidates):
                tried = wanted.tolist()
                for own in map(frozenset, rows.tolist()):
                    counts[[k for k, c in enumerate(tried) if own.issuperset(c)]] += 1
            elif numbered:
                subsets = np.array(list(combinations(range(width), size)))
                step = max(1, CELLS // len(subsets))
                for a in range(0, len(rows), step):
                    own = sum(rows[a : a + step, subsets[:, k]] * digits[k] for k in range(size)).ravel()
                    at = np.minimum(np.searchsorted(numbers, own), len(numbers) - 1)
                    counts[order] += np.bincount(at[numbers[at] == own], minlength=len(counts))
            else:
                for own in rows.tolist():
                    counts[[place[c] for c in combinations(own, size) if c in place]] += 1
        return Counter({candidates[k]: int(counts[k]) for k in np.flatnonzero(counts)})


def contained(part: list[frozenset], candidates: list[tuple]) -> Counter:
    """Baskets that hold each of the candidates, sorted tuples of one size."""
    return Part(part, sorted({x for c in candidates for x in c})).holding(candidates)


def local_frequent(part: list[frozenset], threshold: float, largest: int | None = None) -> list[tuple]:
    """All itemsets in at least ``threshold`` of the baskets of a part, level by level over sorted tuples; with ``largest`` those of at most that many items."""
    count = Counter(x for b in part for x in b)
    level = sorted((x,) for x, n in count.items() if n >= threshold)
    out, coded = list(level), Part(part, [x for (x,) in level])
    while level and (largest is None or len(level[0]) < largest):
        by_prefix: dict[tuple, list] = {}
        for s in level:
            by_prefix.setdefault(s[:-1], []).append(s[-1])
        candidates = [p + (a, b) for p, tails in by_prefix.items() for k, a in enumerate(tails) for b in tails[k + 1 :]]
        known = set(level)
        candidates = [c for c in candidates if all(c[:k] + c[k + 1 :] in known for k in range(len(c) - 2))]
        hits = coded.holding(candidates)
        level = sorted(c for c in candidates if hits[c] >= threshold)
        out += level
    return out


def local_candidates(found: DataFrame, support: int, rows: int = 20_000, largest: int | None = None) -> DataFrame:
    """(items): itemsets (with ``largest``, of at most that many items) frequent in some part of the baskets, at the part's share of the support.

    A part is a piece of a partition, of ``rows`` baskets or as many as it takes for a share of the support of
    ``LEAST_LOCAL`` (less only in a partition that is smaller), and of fewer than twice that, so that a task's
    memory does not follow its input. Which itemsets are candidates depends on the partitions; that every
    frequent one is among them does not.
    """
    total = max(1, found.count())
    size = max(rows, -(-LEAST_LOCAL * total // max(1, support)))

    def run(batches):
        part, kind = [], None

        def sets():
            frequent = local_frequent(part, support * len(part) / total, largest)
            return [pa.RecordBatch.from_arrays([pa.array([list(s) for s in frequent], kind)], names=["items"])] if frequent else []

        for batch in batches:
            kind = batch.schema.field(0).type
            part += [frozenset(x) for x in batch.column(0).to_pylist()]
            while len(part) >= 2 * size:
                part, rest = part[:size], part[size:]
                yield from sets()
                part = rest
        if part:
            yield from sets()

    items = found.select("items").coalesce(-(-total // size))
    return items.mapInArrow(run, items.schema).distinct()


def recount(found: DataFrame, candidates: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(items, n): baskets that hold each of the candidates (a written table), exactly.

    Tasks count against all candidates where these are within ``BROADCAST_BYTES``; else candidates meet baskets
    through their first item.
    """
    items = found.select("items")
    if scratch.bytes_of(name) <= BROADCAST_BYTES:
        by_size: dict[int, list] = {}
        for r in candidates.collect():  # BROADCAST_BYTES at most
            by_size.setdefault(len(r["items"]), []).append(tuple(r["items"]))
        useful = sorted({x for sets in by_size.values() for c in sets for x in c})
        sent = found.sparkSession.sparkContext.broadcast((useful, by_size))

        def run(batches):
            hits: Counter = Counter()  # of all baskets of the task
            part, held = [], 0

            def count():
                useful, by_size = sent.value
                coded = Part(part, useful)
                for same_size in by_size.values():
                    hits.update(coded.holding(same_size))
                part.clear()

            for batch in batches:
                kind = batch.schema.field(0).type
                part += [frozenset(x) for x in batch.column(0).to_pylist()]
                held += len(batch.column(0).flatten())
                if held >= RECOUNTED:
                    count()
                    held = 0
            count()
            if hits:
                sets = pa.array([list(c) for c in hits], kind)
                yield pa.RecordBatch.from_arrays([sets, pa.array(list(hits.values()), pa.int64())], names=["items", "n"])

        kind = items.schema["items"].dataType.simpleString()
        return items.mapInArrow(run, f"items {kind}, n long").groupBy("items").agg(F.sum("n").alias("n"))
    keyed = candidates.select(F.element_at("items", 1).alias("item"), F.col("items").alias("candidate"))
    met = items.select("items", F.explode("items").alias("item")).join(keyed, "item").where(F.size(F.array_except("candidate", "items")) == 0)
    return met.groupBy(F.col("candidate").alias("items")).agg(F.count(F.lit(1)).alias("n"))


def son(found: DataFrame, support: int, largest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, frequent): candidates of the parts, and those that are frequent by an exact recount over all baskets (J4); with ``largest`` those of at most that many items."""
    scratch = Scratch(found.sparkSession, "son")
    found = scratch.write(found.select("items"), "baskets")
    candidates = scratch.write(local_candidates(found, support, largest=largest), "candidates")
    return candidates, recount(found, candidates, scratch, "candidates").where(F.col("n") >= support)
