"""Sharding by bytes: a minimax contiguous partition of ordered atomic groups (operator 2).

Rows with equal texts form a group that stays together. Groups are ordered by a
hash of their text, and neighbours in that order are taken together into
``2**UNIT_BITS`` units, so that the driver sees a fixed number of sizes at any
size of the corpus; a unit is the atom of the partition. The smallest capacity
that ``shards`` contiguous shards can keep is found by binary search, each trial
being checked greedily. The cuts keep that capacity, and of all such cuts they
leave the smallest shard as large as possible, found by binary search as well: the
greedy pass alone would leave all slack to the last shard.

A group larger than a shard's share gets a shard that is as large as it has to
be; the others stay near equal. Slots are dealt without any window over a whole
shard: rows are numbered inside small cells (shard, salt), and the cells' counts,
of a fixed number, give each cell its first slot.

Edge cases: a null text counts as empty (size 8) and groups with empty texts;
repeated rows and null ids are rows like others; an empty table gives no rows;
columns besides id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, id_and_text, within

UNIT_BITS = 16
#: Cells of a shard in which slots are numbered.
CELLS = 2048
#: Bytes that a row costs besides its text.
ROW_BYTES = 8


def shards_needed(ends: np.ndarray, capacity: int, most: int) -> tuple[int, list[int]]:
    """Greedy check: shards that ``capacity`` needs (``most + 1`` if more than ``most``), and the first units of all but the first one."""
    cuts: list[int] = []
    at, base, n = 0, 0, len(ends)
    for used in range(1, most + 1):
        at = int(np.searchsorted(ends, base + capacity, side="right"))
        if at >= n:
            return used, cuts
        base = int(ends[at - 1]) if at else 0
        cuts.append(at)
    return most + 1, cuts


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity and cuts that keep it, the smallest shard being as large as it can be."""
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    if not len(ends) or not ends[-1]:
        return 0, []
    low, high = max(int(max(sizes)), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if shards_needed(ends, middle, shards)[0] <= shards:
            high = middle
        else:
            low = middle + 1
    capacity, floor, ceiling = low, 0, int(ends[-1]) // shards
    cuts = cuts_within(ends, 0, capacity, shards)
    while floor < ceiling:
        middle = (floor + ceiling + 1) // 2
        found = cuts_within(ends, middle, capacity, shards)
        if found is None:
            ceiling = middle - 1
        else:
            floor, cuts = middle, found
    return capacity, cuts


def cuts_within(ends: np.ndarray, least: int, most: int, shards: int) -> list[int] | None:
    """Cuts into exactly ``shards`` contiguous parts, of which each has ``least`` to ``most`` in all; none if there are none."""
    sums = np.concatenate([[0], ends])
    first, last = np.searchsorted(sums, sums - most, "left"), np.searchsorted(sums, sums - least, "right")
    reached = [np.arange(len(sums)) == 0]
    for _ in range(shards):  # positions at which the next part may end
        before = np.concatenate([[0], np.cumsum(reached[-1])])
        reached.append(before[last] > before[first])
    if not reached[-1][-1]:
        return None
    cuts, at = [], len(sums) - 1
    for was in reached[-2:0:-1]:
        at = int(first[at] + np.flatnonzero(was[first[at] : last[at]])[-1])
        cuts.append(at)
    return cuts[::-1]


def shard_by_bytes(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row."""
    scratch = Scratch(df.sparkSession, "sharding")
    text = F.col("text")
    rows = id_and_text(df, id_col, text_col).select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - UNIT_BITS).cast("int").alias("unit"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(CELLS)).cast("int").alias("cell"),  # not of the id: ids may be null or repeat
    )
    rows = scratch.write(rows, "rows")
    sizes = np.zeros(1 << UNIT_BITS, dtype=np.int64)
    for r in rows.groupBy("unit").agg(F.sum("size").alias("size")).collect():  # 2**UNIT_BITS rows at most
        sizes[r["unit"]] = r["size"]
    _, cuts = minimax_cuts(sizes, shards)
    placed = rows.withColumn("shard", within(F.col("unit"), cuts))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = scratch.write(counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "first")
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = placed.withColumn("place", slot).join(F.broadcast(first), ["shard", "cell"])  # shards * CELLS rows at most
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"))
