"""An FM-index over word numbers: wavelet-matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Start positions in suffix order, by doubling. Each 0 is an end mark of its own, in order of position."""
    n = len(codes)
    ends = np.flatnonzero(codes == 0)
    rank = codes.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + int(after.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        steps = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if n == 0 or steps[-1] == n - 1 or width >= n:
            return order
        width *= 2


class _Bits:
    """A bit row with ranks: packed words and a running count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))[:-1]))

    def ones(self, upto: np.ndarray) -> np.ndarray:
        word, bit = upto >> 6, (upto & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """``codes``: word numbers from 1 up; 0 closes each stretch, and the last code must be 0."""

    def __init__(self, codes: np.ndarray, sigma: int):
        n = len(codes)
        order = suffix_order(codes)
        last = codes[order - 1]  # of the suffix at 0 it is the closing 0
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=sigma))))
        self.size, self.levels, self.zeros = n, [], []
        self.first = np.zeros(sigma, np.int64)  # where the symbol's run starts after the last level
        symbols = np.arange(sigma, dtype=np.int64)
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = ((last >> shift) & 1).astype(np.uint8)
            level, zeros = _Bits(bits), int(n - bits.sum())
            ones = level.ones(self.first)
            self.first = np.where((symbols >> shift) & 1 == 1, zeros + ones, self.first - ones)
            self.levels.append((shift, level))
            self.zeros.append(zeros)
            last = np.concatenate((last[bits == 0], last[bits == 1]))
        begins = np.concatenate(([True], codes[:-1] == 0)) if n else np.zeros(0, bool)
        marked = (order % SAMPLE == 0) | begins[order]
        self.marks, self.samples = _Bits(marked.astype(np.uint8)), order[marked]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position ``upto`` of the last column."""
        at = upto
        for (shift, level), zeros in zip(self.levels, self.zeros, strict=True):
            ones = level.ones(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at - self.first[symbol]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search for phrases of one length (rows): the half-open row range of each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            symbol = phrases[live, column]
            low[live] = self.counts[symbol] + self.rank(symbol, low[live])
            high[live] = self.counts[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled suffix. The start of each stretch is sampled."""
        rows = rows.copy()
        found, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.marks.get(at)
            found[open_[hit]] = self.samples[self.marks.ones(at[hit])] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
            symbol = np.zeros(len(at), np.int64)
            for (shift, level), zeros in zip(self.levels, self.zeros, strict=True):
                bit, ones = level.get(at), level.ones(at)
                symbol |= bit.astype(np.int64) << shift
                at = np.where(bit, zeros + ones, at - ones)
            rows[open_] = self.counts[symbol] + at - self.first[symbol]
            steps[open_] += 1
        return found
