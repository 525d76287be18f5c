"""A word-level FM-index: suffix order, Burrows-Wheeler transform, wavelet-tree ranks and sampled suffix positions.

All steps are vectorised numpy. Symbol 0 ends a run of text: patterns never contain it, and each 0 counts as a symbol of
its own, smaller than any other and ordered by place.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in order. ``text`` ends with 0. Prefix doubling; only suffixes that are
    not yet told apart are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable").astype(np.int64)
    ordered = text[order]
    first = np.empty(n, bool)
    first[:1] = True
    first[1:] = (ordered[1:] != ordered[:-1]) | (ordered[1:] == 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    last = np.append(first[1:], True)
    open_ = np.flatnonzero(~(first & last))
    step = 1
    while len(open_):
        suffix = order[open_]
        key = rank[suffix] * n + rank[suffix + step]  # an open suffix has no 0 in its first ``step`` symbols
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[open_] = suffix
        first = np.append(True, key[1:] != key[:-1])
        rank[suffix] = open_[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        open_ = open_[~(first & np.append(first[1:], True))]
        step *= 2
    return order


class Bits:
    """A bit vector with constant-time ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(ones[:-1], dtype=np.int64))).astype(np.int32)
        self.ones = int(self.before[-1]) + int(ones[-1])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletTree:
    """Ranks of symbols: one bit vector for each bit of the symbols, high to low, each level's zeros before its ones."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.size = len(text)
        self.levels, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (text >> level) & 1 != 0
            self.levels.append(Bits(bit))
            self.zeros.append(len(text) - self.levels[-1].ones)
            text = np.concatenate((text[~bit], text[bit]))
        every = np.arange(symbols)
        self.start = self._down(every, np.zeros(symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.levels):
            one = bits.rank(i)
            i = np.where((c >> (self.depth - 1 - k)) & 1 != 0, self.zeros[k] + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol c stands before place i."""
        return self._down(c, i) - self.start[c]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.zeros(len(i), np.int64)
        for k, bits in enumerate(self.levels):
            here, one = bits.get(i), bits.rank(i)
            i = np.where(here, self.zeros[k] + one, i - one)
            c = 2 * c + here
        return c, i - self.start[c]


class FMIndex:
    """``text``: symbols from 1, each run of text closed by 0. ``symbols``: one more than the largest symbol there can be."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        n = len(text)
        order = suffix_order(text)
        counts = np.bincount(text, minlength=symbols)
        self.size = n
        self.before = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.tree = WaveletTree(text[order - 1], symbols)
        # A walk back must end within its run, so each run's first place is sampled too.
        kept = (order % sample == 0) | (text[order - 1] == 0)
        self.kept, self.places = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each row of ``patterns`` (all of one length); empty where there is none."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j].astype(np.int64)
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which interval, text position) of every suffix in the intervals."""
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        place = np.empty(len(which), np.int64)
        todo, steps = np.arange(len(which)), 0
        while len(todo):
            done = self.kept.get(at)
            place[todo[done]] = self.places[self.kept.rank(at[done])] + steps
            todo, at, steps = todo[~done], at[~done], steps + 1
            c, r = self.tree.symbol_and_rank(at)
            at = self.before[c] + r
        return which, place
