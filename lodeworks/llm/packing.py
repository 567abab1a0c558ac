"""Hierarchical packing into windows of several lengths (operator 9).

A document's ids, with an end mark, are cut into full windows of the longest
length and a rest. Rests are routed to tiers, the smallest window length that
holds them. From the longest tier down, a window is opened by the longest waiting
piece of its tier; its gap is filled with the longest pieces of shorter tiers
that fit, and the head of one more piece fills what is left. The last window of a
block falls into windows whose lengths are powers of two, so that none has any
padding. Windows are dealt to step groups of near equal token counts.

Tasks tokenise and pack what they read, in blocks of a bounded number of tokens,
so that there is no shuffle and what a task holds does not follow its input.
Which documents share a window therefore depends on how the input is split into
tasks; which ids a document has, and that each lies in one piece, does not.

Edge cases: a null or empty text is its end mark alone; a text of any length is
cut into windows; repeated rows are packed each; an empty table gives no rows;
columns besides id and text are ignored. A row with a null id is packed like any
other.
"""

from __future__ import annotations

import bisect
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeworks.llm.bpe import BYTE_LEVEL, _loaded, read_spec
from lodeworks.llm.common import arrow_schema, id_and_text, tidy

TIERS = (128, 256, 512, 1024, 2048)
BLOCK_TOKENS = 1 << 22
BLOCK_ROWS = 20_000
#: Windows of the longest length that a step takes.
STEP_WINDOWS = 16
END_ID = 1


def pack(lengths, tiers=TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of pieces (row, start, length); every token of every row lies in one piece."""
    top = tiers[-1]
    windows, waiting = [], []
    for row, n in enumerate(lengths):
        full = n // top * top
        windows += [[(row, at, top)] for at in range(0, full, top)]
        if n > full:
            waiting.append((n - full, row, full))
    waiting.sort()
    while waiting:
        n, row, start = waiting.pop()
        size = tiers[bisect.bisect_left(tiers, n)]
        window, gap = [(row, start, n)], size - n
        while gap and waiting:
            k = bisect.bisect_right(waiting, (gap, float("inf"), 0)) - 1
            n, row, start = waiting.pop(max(k, 0))
            if n > gap:  # the shortest one is too long: its head fills the gap
                bisect.insort(waiting, (n - gap, row, start + gap))
                n = gap
            window.append((row, start, n))
            gap -= n
        windows += [window] if not gap else _exact(window)
    return windows


def _exact(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of a window that cannot be filled, as windows of powers of two, longest first."""
    left, out = sum(p[2] for p in pieces), []
    for size in (1 << k for k in reversed(range(left.bit_length()))):
        if left & size:
            window, need = [], size
            while need:
                row, start, n = pieces.pop(0)
                if n > need:
                    pieces.insert(0, (row, start + need, n - need))
                    n = need
                window.append((row, start, n))
                need -= n
            out.append(window)
    return out


def step_groups(sizes: list[int], tokens: int) -> list[int]:
    """A group for each window: longest first, each to the lightest group, with as many groups as steps of ``tokens``."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // tokens)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        weight, g = heapq.heappop(groups)
        out[k] = g
        heapq.heappush(groups, (weight + sizes[k], g))
    return out


@lru_cache(maxsize=2)
def _fast_encoder(spec: str):
    """Encoder of a byte-level vocabulary: the text library's where ids are merge ranks, else our own."""
    bpe = _loaded(spec)
    by_rank = bpe._bytewise and not bpe.suffix and not bpe._normal and all(bpe.vocab.get(a + b) == 256 + k for (a, b), k in bpe.ranks.items())
    if not by_rank:
        return lambda text: np.frombuffer(bpe.encode_packed(text), dtype="<u4")
    import tiktoken

    ranks = {bpe._raw[k]: k for k in bpe.vocab.values()}
    fast = tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens=bpe.special)

    def encode(text: str) -> np.ndarray:
        if len(text) <= 1_000_000:
            return np.array(fast.encode(text, allowed_special="all"), dtype="<u4")
        return np.frombuffer(bpe.encode_packed(text), dtype="<u4")  # its pattern library has a backtracking limit

    return encode


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("step_group", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def pack_documents(df: DataFrame, vocabulary: str, tiers=TIERS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece, with its ids packed as little-endian unsigned 32-bit integers."""
    sent = df.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    kind = arrow_schema(PIECES)

    def flush(docs: list[tuple[int, np.ndarray]], first: int):
        windows = pack([len(ids) for _, ids in docs], tiers)
        sizes = [sum(p[2] for p in w) for w in windows]
        groups = step_groups(sizes, STEP_WINDOWS * tiers[-1])
        for lo in range(0, len(windows), 256):
            rows = []
            for k in range(lo, min(lo + 256, len(windows))):
                at = 0
                for row, start, n in windows[k]:
                    doc_id, ids = docs[row]
                    tier = tiers[bisect.bisect_left(tiers, sizes[k])]
                    rows.append((doc_id, start, n, len(ids), first + k, at, tier, first + groups[k], ids[start : start + n].tobytes()))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    def run(batches):
        encode, part = _fast_encoder(sent.value), TaskContext.get().partitionId()
        docs, held, block = [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.array([end_id], dtype="<u4"))
                docs.append((doc_id, ids))
                held += len(ids)
                if held >= BLOCK_TOKENS or len(docs) >= BLOCK_ROWS:
                    yield from flush(docs, (part << 42) | (block << 24))
                    docs, held, block = [], 0, block + 1
        if docs:
            yield from flush(docs, (part << 42) | (block << 24))

    return id_and_text(df, id_col, text_col).mapInArrow(tidy(run), PIECES)
