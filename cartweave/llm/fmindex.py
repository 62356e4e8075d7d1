"""FM-index of a sequence of small integers: wavelet-tree ranks, batched backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank in constant time: counts per 64-bit word, and the bits themselves."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 2, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """Level-wise (matrix) layout: on each level a bit of every symbol, zeros moved before ones for the next."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.shifts = range(max(1, (size - 1).bit_length()) - 1, -1, -1)
        self.levels: list[tuple[Bits, int]] = []
        for s in self.shifts:
            bit = ((symbols >> s) & 1).astype(bool)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i; all arguments are arrays."""
        low = np.zeros_like(i)
        for s, (bits, zeros) in zip(self.shifts, self.levels, strict=True):
            one = ((symbol >> s) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each i, and how often it is before i."""
        low, symbol = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in self.levels:
            one = bits.get(i)
            symbol = symbol << 1 | one
            a, b = bits.rank(low), bits.rank(i)
            low, i = np.where(one == 1, zeros + a, low - a), np.where(one == 1, zeros + b, i - b)
        return symbol, i - low


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Prefix doubling; t ends with its only 0. The first round already sorts by as many symbols as fit in 62 bits."""
    n, bits = len(t), max(1, (size - 1).bit_length())
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(k):
        key <<= bits
        if i < n:
            key[: n - i] |= t[i:]
    while True:
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        k *= 2


class FMIndex:
    """Of symbols from 1 to size - 1. ``rate``: every so many positions one is sampled for ``locate``."""

    def __init__(self, symbols: np.ndarray, size: int, rate: int = 16):
        t = np.append(symbols.astype(np.int64), 0)
        order = suffix_array(t, size)
        self.n, self.rate = len(t), rate
        self.tree = WaveletTree(t[order - 1], size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=size))])
        sampled = order % rate == 0
        self.sampled, self.position = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns at once (rows of symbols, left-aligned): first row and end row of each."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero((lengths >= step) & (low < high))
            if not len(on):
                break
            c = patterns[on, lengths[on] - step]
            low[on] = self.smaller[c] + self.tree.rank(c, low[on])
            high[on] = self.smaller[c] + self.tree.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row of the index: step back to a sampled one."""
        out, steps, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            done = self.sampled.get(rows) == 1
            out[left[done]] = self.position[self.sampled.rank(rows[done])] + steps
            left, rows = left[~done], rows[~done]
            symbol, before = self.tree.access_rank(rows)
            rows, steps = self.smaller[symbol] + before, steps + 1
        return out
