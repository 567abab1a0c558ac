"""Counting quotient filters in numpy, and their lossless merge.

A 64-bit fingerprint is split into a quotient (its upper bits) and a remainder.
Remainders lie in one table in order of (quotient, remainder), each at the first
free slot from its quotient on; a bit for each quotient tells whether it is in
use, a bit for each slot whether a quotient's run ends there, and each slot has
its fingerprint's count. As no bit of a fingerprint is lost, two filters merge
into the filter of both inputs.
"""

from __future__ import annotations

import numpy as np


class CountingQuotientFilter:
    def __init__(self, q: int, occupied: np.ndarray, run_end: np.ndarray, used: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.occupied, self.run_end, self.used, self.remainders, self.counts = q, occupied, run_end, used, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, shared_bits: int = 0) -> CountingQuotientFilter:
        """Filter of fingerprints (uint64) whose upper ``shared_bits`` bits are the same."""
        order = np.argsort(fingerprints, kind="stable")
        return cls._counted(fingerprints[order], np.ones(len(order), dtype=np.int64) if counts is None else counts[order], shared_bits)

    @classmethod
    def _counted(cls, values: np.ndarray, weights: np.ndarray, shared_bits: int) -> CountingQuotientFilter:
        """Filter of ascending fingerprints with their weights."""
        first = np.ones(len(values), dtype=bool)
        first[1:] = values[1:] != values[:-1]
        starts = np.flatnonzero(first)
        values = values[starts]
        totals = np.add.reduceat(weights, starts) if len(starts) else weights[:0]
        q = max(3, int(np.ceil(np.log2(max(1, len(values)) / 0.75))))
        return cls._laid(q, values, totals, shared_bits)

    @classmethod
    def _laid(cls, q: int, values: np.ndarray, totals: np.ndarray, shared_bits: int) -> CountingQuotientFilter:
        quotients = ((values << np.uint64(shared_bits)) >> np.uint64(64 - q)).astype(np.int64)
        keep = np.uint64(64 - q - shared_bits)
        remainders = values & ((np.uint64(1) << keep) - np.uint64(1))
        k = np.arange(len(values))
        slots = k + np.maximum.accumulate(quotients - k) if len(values) else k  # linear probing in sorted order
        size = max(1 << q, int(slots[-1]) + 1 if len(slots) else 0)
        occupied, run_end, used = np.zeros(1 << q, dtype=bool), np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        table, held = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
        occupied[quotients] = True
        used[slots], table[slots], held[slots] = True, remainders, totals
        last = np.ones(len(values), dtype=bool)
        last[:-1] = quotients[1:] != quotients[:-1]
        run_end[slots[last]] = True
        return cls(q, occupied, run_end, used, table, held)

    def items(self, prefix: int = 0, shared_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in ascending order, and their counts: the k-th run belongs to the k-th occupied quotient."""
        at = np.flatnonzero(self.used)
        run = np.cumsum(self.run_end[at]) - self.run_end[at]
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)[run] if len(at) else np.zeros(0, dtype=np.uint64)
        out = (quotients << np.uint64(64 - self.q - shared_bits)) | self.remainders[at]
        if shared_bits:
            out |= np.uint64(prefix) << np.uint64(64 - shared_bits)
        return out, self.counts[at]

    def dump(self) -> bytes:
        """Bytes: sizes, the bits, and the slots in use."""
        head = np.array([self.q, len(self.used), int(self.used.sum())], dtype="<i8").tobytes()
        bits = [np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.used)]
        counts = self.counts[self.used]
        wide = np.flatnonzero(counts > 254)
        small = np.where(counts > 254, 255, counts).astype(np.uint8).tobytes()
        return b"".join([head, *bits, self.remainders[self.used].astype("<u8").tobytes(), small, counts[wide].astype("<i8").tobytes()])

    @classmethod
    def load(cls, data: bytes) -> CountingQuotientFilter:
        q, size, n = np.frombuffer(data, dtype="<i8", count=3).tolist()
        at, parts = 24, []
        for length in (1 << q, size, size):
            parts.append(np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=-(-length // 8), offset=at), count=length).astype(bool))
            at += -(-length // 8)
        remainders, counts = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
        remainders[parts[2]] = np.frombuffer(data, dtype="<u8", count=n, offset=at)
        small = np.frombuffer(data, dtype=np.uint8, count=n, offset=at + 8 * n).astype(np.int64)
        wide = small == 255
        small[wide] = np.frombuffer(data, dtype="<i8", count=int(wide.sum()), offset=at + 9 * n)
        counts[parts[2]] = small
        return cls(q, parts[0], parts[1], parts[2], remainders, counts)

    def merged(self, other: CountingQuotientFilter, prefix: int = 0, shared_bits: int = 0) -> CountingQuotientFilter:
        """Filter of both: their sorted runs are merged, without sorting again, and laid out anew, counts of equal ones added."""
        (a, n), (b, m) = self.items(prefix, shared_bits), other.items(prefix, shared_bits)
        values, counts = np.empty(len(a) + len(b), dtype=np.uint64), np.empty(len(a) + len(b), dtype=np.int64)
        for own, number, place in ((a, n, np.searchsorted(b, a, "left")), (b, m, np.searchsorted(a, b, "right"))):
            place = place + np.arange(len(own))
            values[place], counts[place] = own, number
        return CountingQuotientFilter._counted(values, counts, shared_bits)
