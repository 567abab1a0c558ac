"""Similar users of ratings, block by block (survey D11, D12, E14-E17, F2).

Users are numbered in order and cut into blocks. A block is sent its own users' ratings, the pairs to predict, and the
ratings of all others under the items it has, sorted by user; these stream by, so that a task holds its block and one
chunk. What two users have in common is summed in arrays: pairs of users are neither shuffled nor written. Chunks
travel packed, a row for each block and chunk: sorting and converting a row for each rating and block took most of the
time and of the disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.counts import ordinals
from lodeworks.plans.stages import Scratch

#: Blocks of users at least, if there are as many users, and ratings of a block at most, on average.
LEAST_BLOCKS, BLOCK_ROWS = 24, 1 << 20
#: Blocks times ranges of items, at most, for which it is noted whether a block has the range and so is sent its ratings.
TOUCHED = 1 << 15
#: Ratings of others in a chunk, at least, and cells or meetings of users that a task works on at once.
CHUNK_ROWS, CELLS = 1 << 18, 1 << 21


class Coded:
    """Ratings under ordinals of users and items, written."""

    def __init__(self, train: DataFrame, of: str = "user", over: str = "item"):
        self.scratch = scratch = Scratch(train.sparkSession, "neighbours")
        self.users = scratch.write(ordinals(train, of, "u"), "users")
        self.items = scratch.write(ordinals(train, over, "i"), "items")
        rows = train.join(self.users, of).join(self.items, over)
        self.rows = scratch.write(rows.select("u", "i", F.col(of).alias("v"), F.col("rating").cast("double").alias("r")), "rows")
        self.n, n_rows = self.users.count(), self.rows.count()
        self.blocks = max(1, min(self.n, max(LEAST_BLOCKS, -(-n_rows // BLOCK_ROWS))))

    def block(self):
        return F.floor(F.col("u") * self.blocks / max(1, self.n)).cast("int")

    def dealt(self, test: DataFrame | None) -> DataFrame:
        """What each block is sent, by block, in order: ``PACKED`` rows; without ``test`` with the users' keys, and of the others only larger users."""
        rows = self.rows.withColumn("block", self.block())
        given = rows.select("block", "u", F.lit(0).alias("side"), "i", "r", *([] if test is not None else ["v"]))
        if test is not None:
            given = given.union(test.withColumn("block", self.block()).select("block", "u", F.lit(1).alias("side"), "i", F.lit(None).cast("double").alias("r")))
        ranges = max(1, TOUCHED // self.blocks)
        each = max(1, -(-self.items.count() // ranges))  # items of a range
        found = given.select("block", F.floor(F.col("i") / each).cast("int").alias("range")).distinct().toArrow()
        touched = np.zeros((self.blocks, ranges), bool)
        touched[found["block"].to_numpy(), found["range"].to_numpy()] = True
        given = given.repartitionById(self.blocks, F.col("block")).sortWithinPartitions("block", "u", "side", "i")
        packed = given.mapInArrow(_packer(touched, each, CHUNK_ROWS, test is None), PACKED)
        return packed.repartitionById(self.blocks, F.col("block")).sortWithinPartitions("block", "side", "u")


#: What a block is sent, packed. Side 0: its users' ratings, 1: pairs to predict, 2: a chunk of others' ratings by item, with
#: each user's number of ratings and their sum; u is the first user. A chunk's ratings are numbers of ``ratings``, whose last one, a NaN, is for nulls;
#: its items are their distances. For similarities there are no sizes and totals, but the keys of the users, each once.
_ARRAYS = ("users", "items", "counts", "at", "codes", "ratings", "sizes", "totals", "keys")
PACKED = "block int, side int, u long, " + ", ".join(f"{c} binary" for c in _ARRAYS)


def _narrow(x: np.ndarray, top: int) -> np.ndarray:
    return x.astype(np.uint8 if top <= 1 << 8 else np.uint16 if top <= 1 << 16 else np.uint32)


def _wide(data: bytes, n: int) -> np.ndarray:
    """As given to ``_narrow``, n numbers."""
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.zeros(0, np.uint8)


def _sent(values: pa.ChunkedArray) -> np.ndarray:
    """Bytes of keys of any type."""
    sink = pa.BufferOutputStream()
    table = pa.table({"v": values})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return np.frombuffer(sink.getvalue(), np.uint8)


def _received(data: list[bytes]) -> pa.Array:
    """As given to ``_sent``, one after another."""
    return pa.concat_arrays([x for d in data for x in pa.ipc.open_stream(d).read_all()["v"].chunks])


def _packer(touched: np.ndarray, each: int, chunk_rows: int, keyed: bool = False):
    """The function from (block, u, side, i, r), by block and user, to ``PACKED`` rows; a user's ratings are never cut. ``keyed``: with v, the keys, and for no larger block."""

    def row(block, side, u, **arrays):
        if side == 2:
            gaps = np.diff(arrays["items"], prepend=0)
            arrays |= {"items": _narrow(gaps, int(gaps.max()) + 1), "counts": arrays["counts"].astype(np.uint32)}
        data = [pa.array([arrays[c].tobytes() if c in arrays else None], pa.binary()) for c in _ARRAYS]
        head = [pa.array([block], pa.int32()), pa.array([side], pa.int32()), pa.array([u], pa.int64())]
        return pa.RecordBatch.from_arrays([*head, *data], names=["block", "side", "u", *_ARRAYS])

    def packed(table):
        block, u, side, i = (table[c].to_numpy() for c in ("block", "u", "side", "i"))
        empty, r = table["r"].is_null().to_numpy(), table["r"].fill_null(0.0).to_numpy()
        for b in np.unique(block):
            for s in (0, 1):
                mine = (block == b) & (side == s)
                if mine.any():
                    own = {} if s else {"ratings": r[mine]}
                    if keyed:
                        own["keys"] = _sent(table["v"].take(pa.array(np.flatnonzero(mine)[np.unique(u[mine], return_index=True)[1]])))
                    yield row(int(b), s, int(u[mine][0]), users=u[mine], items=i[mine], **own)
        rated = side == 0
        if not rated.any():
            return
        u, i, r, empty = u[rated], i[rated], r[rated], empty[rated]
        users, first, at = np.unique(u, return_index=True, return_inverse=True)
        of_user = {"keys": _sent(table["v"].take(pa.array(first)))} if keyed else {"sizes": np.bincount(at), "totals": np.bincount(at, r)}
        ratings, codes = np.unique(r, return_inverse=True)
        codes[empty] = len(ratings)
        ratings = np.append(ratings, np.nan)
        order = np.argsort(i, kind="stable")
        i, at, codes = i[order], _narrow(at[order], len(users)), _narrow(codes[order], len(ratings))
        items, first, counts = np.unique(i, return_index=True, return_counts=True)
        whole = {"users": users, "ratings": ratings} | of_user
        for b in range(int(block.max()) + 1 if keyed else len(touched)):
            sent = touched[b][items // each]
            if sent.all():
                yield row(b, 2, int(users[0]), items=items, counts=counts, at=at, codes=codes, **whole)
            elif sent.any():
                kept = np.repeat(sent, counts)
                yield row(b, 2, int(users[0]), items=items[sent], counts=counts[sent], at=at[kept], codes=codes[kept], **whole)

    def run(batches):
        rows, held, limit = [], 0, chunk_rows
        for batch in batches:
            rows.append(batch)
            held += len(batch)
            if held >= limit:
                table = pa.Table.from_batches(rows)
                u = table["u"].to_numpy()
                cut = int(np.searchsorted(u, u[-1]))
                if cut:
                    yield from packed(table.slice(0, cut))
                rows = table.slice(cut).combine_chunks().to_batches()
                held = len(u) - cut
                limit = max(chunk_rows, 2 * held)  # twice what one user has so far, who must not be cut
        if held:
            yield from packed(pa.Table.from_batches(rows))

    return run


def _ranges(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): for each row its places low, low + 1, ..., count of them."""
    row = np.repeat(np.arange(len(low)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def _pearson(n, sx, sy, sxx, syy, sxy) -> np.ndarray:
    """As ``stats.pearson``, from sums."""
    cov, vx, vy = n * sxy - sx * sy, n * sxx - sx * sx, n * syy - sy * sy
    with np.errstate(all="ignore"):
        below = np.sqrt(vx) * np.sqrt(vy)
        return np.where((cov == 0) | (below == 0), 0.0, cov / below)


class _Chunk:
    """Ratings of some of the others, all of each that a block can meet, by item."""

    def __init__(self, row: dict, own_value: bool):
        """From a ``PACKED`` row. A rating's value is itself, or else its distance from its user's mean without it."""
        self.users, self.count = np.frombuffer(row["users"], np.int64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.items = np.cumsum(_wide(row["items"], len(self.count)), dtype=np.int64)
        self.start, n = np.cumsum(self.count) - self.count, int(self.count.sum())
        self.local = _wide(row["at"], n).astype(np.int64)
        codes, ratings = _wide(row["codes"], n), np.frombuffer(row["ratings"])
        empty = codes == len(ratings) - 1
        self.r = np.where(empty, 0.0, ratings[codes])  # a null adds nothing to a sum
        if own_value:
            self.value = self.r
        else:
            rest, total = np.frombuffer(row["sizes"], np.int64)[self.local] - 1, np.frombuffer(row["totals"])[self.local]
            self.value = np.where(empty | (rest == 0), 0.0, self.r - (total - self.r) / np.maximum(rest, 1))

    def of_items(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, count): places of the items' ratings."""
        if not len(self.items):
            return np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        at = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1)
        return self.start[at], np.where(self.items[at] == items, self.count[at], 0)


class _Block:
    """A block's users, their ratings and their pairs to predict, sorted by user and item."""

    def __init__(self, own: dict[str, np.ndarray], asked: dict[str, np.ndarray]):
        self.own, self.asked = own, asked
        self.users = np.unique(np.concatenate([own["u"], asked["u"]]))
        self.slots = np.full(0, -1, np.int32)

    def batches(self, chunk: _Chunk, only_asked: bool) -> Iterator[tuple]:
        """(users, rows of own ratings, rows of pairs) of as many users at once as ``CELLS`` allows."""
        low, count = chunk.of_items(self.own["i"])
        start = np.searchsorted(self.own["u"], np.append(self.users, np.iinfo(np.int64).max))
        asked = np.searchsorted(self.asked["u"], np.append(self.users, np.iinfo(np.int64).max))
        met = np.append(0, np.cumsum(count))[start]
        a, most = 0, max(1, CELLS // max(1, len(chunk.users)))
        while a < len(self.users):
            b = min(len(self.users), a + most, max(a + 1, int(np.searchsorted(met, met[a] + CELLS, "right")) - 1))
            if met[b] > met[a] or (only_asked and asked[b] > asked[a]):
                own = slice(start[a], start[b])
                yield self.users[a:b], own, low[own], count[own], slice(asked[a], asked[b])
            a = b

    def predicted(self, chunk: _Chunk) -> Iterator[tuple]:
        """(pair, value, sim) arrays, by pair and user: the raters in the chunk of each pair's item."""
        width = len(chunk.users)
        for users, own, low, count, asked in self.batches(chunk, True):
            item_low, item_count = chunk.of_items(self.asked["i"][asked])
            pair, place = _ranges(item_low, item_count)
            if not len(pair):
                continue
            cell = (np.searchsorted(users, self.asked["u"][asked]) * width)[pair] + chunk.local[place]
            if len(self.slots) < len(users) * width:
                self.slots = np.full(len(users) * width, -1, np.int32)
            slots, m = self.slots, len(cell)
            slots[cell] = np.arange(m, dtype=np.int32)
            mine = slots[cell]
            ends = np.cumsum(count)  # as in _ranges, but rows are found for the needed ones only, a few in a hundred
            met = np.arange(ends[-1] if len(ends) else 0)
            met += np.repeat(low - ends + count, count)
            slot = chunk.local[met]
            slot += np.repeat(np.searchsorted(users, self.own["u"][own]) * width, count)
            slot = slots[slot]
            slots[cell] = -1
            needed = np.flatnonzero(slot >= 0)
            slot, x, y = slot[needed], self.own["r"][own][np.searchsorted(ends, needed, "right")], chunk.r[met[needed]]
            sums = [np.bincount(slot, w, m) for w in (None, x, y, x * x, y * y, x * y)]
            sim = _pearson(*sums)[mine]
            pair = pair + asked.start
            good = chunk.users[chunk.local[place]] != self.asked["u"][pair]
            yield pair[good], chunk.value[place][good], sim[good]

    def similar(self, chunk: _Chunk) -> Iterator[tuple]:
        """(user, other, sim) arrays: places of the block's users, of larger users in the chunk, similarity of those with something in common."""
        width = len(chunk.users)
        for users, own, low, count, _ in self.batches(chunk, False):
            row, met = _ranges(low, count)
            cell, x, y = np.searchsorted(users, self.own["u"][own])[row] * width + chunk.local[met], self.own["r"][own][row], chunk.r[met]
            cells, at = np.unique(cell, return_inverse=True) if 16 * len(cell) < len(users) * width else (None, cell)
            m = len(users) * width if cells is None else len(cells)
            sums = [np.bincount(at, w, m) for w in (None, x, y, x * x, y * y, x * y)]
            found = np.flatnonzero(sums[0])
            sim = _pearson(*(s[found] for s in sums))
            cells = found if cells is None else cells
            a, b = cells // width, cells % width
            larger = chunk.users[b] > users[a]
            yield np.searchsorted(self.users, users[0]) + a[larger], b[larger], sim[larger]


def _begun(own: list[dict], asked: list[dict]) -> _Block:
    """The block of its ``PACKED`` rows."""
    column = lambda parts, c, kind: np.concatenate([np.frombuffer(x[c], kind) for x in parts]) if parts else np.zeros(0, kind)
    kinds = {"u": ("users", np.int64), "i": ("items", np.int64)}
    return _Block({c: column(own, *x) for c, x in (kinds | {"r": ("ratings", np.float64)}).items()}, {c: column(asked, *x) for c, x in kinds.items()})


def _blocks(batches, begun, run, done):
    """What ``run(block, row)`` yields for the chunks of each block, which is ``begun(own rows, asked rows)``, and ``done(block)`` after them."""
    block, now, parts = None, None, ([], [])
    for batch in batches:
        for at in range(len(batch)):
            row = {c: x[0].as_py() for c, x in zip(batch.schema.names, batch.slice(at, 1).columns, strict=True)}
            if row["block"] != now:
                if now is not None:
                    yield from done(block or begun(*parts))
                block, now, parts = None, row["block"], ([], [])
            if row["side"] < 2:
                parts[row["side"]].append(row)
                continue
            block = block or begun(*parts)
            yield from run(block, row)
    if now is not None:
        yield from done(block or begun(*parts))


def _mover(k: int | None, own_value: bool = False):
    """The function from a task's rows (as ``Coded.dealt`` orders them) to (u, i, move)."""

    def begun(own, asked):
        block = _begun(own, asked)
        n = len(block.asked["u"])
        block.sums = np.zeros((3, n))  # of products, of weights, raters
        if k is not None:
            block.sim, block.value = np.full((n, k), -np.inf), np.zeros((n, k))
        return block

    def run(block, row):
        for pair, value, sim in block.predicted(_Chunk(row, own_value)):
            if k is None:
                for total, w in zip(block.sums, (value * sim, np.abs(sim), None), strict=True):
                    total += np.bincount(pair, w, len(total))
            else:
                _best(block.sim, block.value, pair, value, sim)
        return ()

    def done(block):
        products, weights, raters = block.sums
        if k is not None:
            found = block.sim != -np.inf
            sim = np.where(found, block.sim, 0.0)
            products, weights, raters = (block.value * sim).sum(1), np.abs(sim).sum(1), found.sum(1)
        with np.errstate(all="ignore"):
            move = np.where((products == 0) | (weights == 0), 0.0, products / weights)
        some = np.flatnonzero(raters)
        for a in range(0, len(some), 1 << 16):
            s = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(block.asked["u"][s]), pa.array(block.asked["i"][s]), pa.array(move[s])], names=["u", "i", "move"])

    return lambda batches: _blocks(batches, begun, run, done)


def moves(test: DataFrame, train: DataFrame, k: int | None = None, of: str = "user", over: str = "item", own_value: bool = False) -> DataFrame:
    """(user, item, move) of the pairs in ``test`` that have raters: the weighted distance of these from their own means.

    Of all other raters of the item, or of the ``k`` most similar, the smaller user first on ties. The similarity is
    Pearson's, 0 with nothing in common; a user not in ``train`` has no move. With ``of`` and ``over`` exchanged, of the
    other items that the user rated; with ``own_value``, the weighted rating instead of the distance.
    """
    coded = Coded(train, of, over)
    asked = test.select("user", "item").distinct().join(coded.users, of).join(coded.items, over)
    asked = coded.scratch.write(asked, "asked")

    moved = coded.scratch.write(coded.dealt(asked).mapInArrow(_mover(k, own_value), "u long, i long, move double"), "moved")
    return moved.join(asked, ["u", "i"]).select("user", "item", "move")


def _best(best_sim: np.ndarray, best_value: np.ndarray, pair: np.ndarray, value: np.ndarray, sim: np.ndarray) -> None:
    """Enter raters, by pair and user and larger than those of before, among the most similar of each pair, the smaller user first on ties."""
    k = best_sim.shape[1]
    hope = ~(sim <= best_sim[pair, k - 1])  # most are behind the last of the best already
    pair, value, sim = pair[hope], value[hope], sim[hope]
    if not len(pair):
        return
    old = pair[np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))]
    row, place = np.nonzero(best_sim[old] != -np.inf)
    row = old[row]
    pair, value, sim = np.append(row, pair), np.append(best_value[row, place], value), np.append(best_sim[row, place], sim)
    order = np.lexsort((-sim, pair))  # stable: users stay in order
    pair = pair[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    place = np.arange(len(pair)) - np.repeat(first, np.diff(np.append(first, len(pair))))
    good = place < k
    best_sim[pair[good], place[good]], best_value[pair[good], place[good]] = sim[order[good]], value[order[good]]


def similarities(train: DataFrame, of: str, over: str) -> DataFrame:
    """(a, b, sim): Pearson of every ordered pair of different ``of`` that have an ``over`` in common."""
    coded = Coded(train, of, over)

    def begun(own, asked):
        block = _begun(own, asked)
        block.keys = _received([x["keys"] for x in own])
        return block

    def run(block, row):
        keys = _received([row["keys"]])
        for mine, theirs, sim in block.similar(_Chunk(row, True)):
            for x in range(0, len(sim), 1 << 16):
                at = slice(x, x + (1 << 16))
                a, b, sims = block.keys.take(pa.array(mine[at])), keys.take(pa.array(theirs[at])), pa.array(sim[at])
                for pair in ((a, b), (b, a)):
                    yield pa.RecordBatch.from_arrays([*pair, sims], names=["a", "b", "sim"])

    kind = coded.rows.schema["v"].dataType.simpleString()
    return coded.dealt(None).mapInArrow(lambda batches: _blocks(batches, begun, run, lambda block: ()), f"a {kind}, b {kind}, sim double")
