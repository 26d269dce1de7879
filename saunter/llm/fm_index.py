"""An FM-index over a shard of word sequences, in numpy, all patterns at a time.

The shard is one string: the words of its documents, a separator of its own behind each,
and an end symbol. Suffixes are sorted by prefix doubling; the transform is kept as a
wavelet matrix (a bit vector per bit of a symbol, with block counts for ranks); every
``SAMPLE``-th text position is kept for locating.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


class Bits:
    """A bit vector with ranks in constant time."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before each position."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Start positions of the suffixes in sorted order; ``text`` ends in a symbol found nowhere else."""
    n, width = len(text), max(1, int(symbols).bit_length())
    step = max(1, 62 // width)
    padded = np.concatenate([text, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = key << width | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)
    first = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = start
    alone = first & np.append(first[1:], True)
    open_at = np.flatnonzero(~alone)  # places in the order that share their rank with another
    while len(open_at):
        pos = order[open_at]
        key = rank[pos] << 31 | rank[np.minimum(pos + step, n - 1)]
        by = np.argsort(key)
        pos, key = pos[by], key[by]
        order[open_at] = pos
        first = np.concatenate([[True], key[1:] != key[:-1]])
        start = open_at[np.maximum.accumulate(np.where(first, np.arange(len(pos)), 0))]
        rank[pos] = start
        alone = first & np.append(first[1:], True)
        open_at = open_at[~alone]
        step *= 2
    return order


class FmIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text, symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        row = text[order - 1]  # position -1 is the end symbol's place: the string as a cycle
        self.levels, self.shifts = [], range(max(1, int(symbols).bit_length()) - 1, -1, -1)
        for s in self.shifts:
            bit = (row >> s & 1).astype(bool)
            self.levels.append(Bits(bit))
            row = np.concatenate([row[~bit], row[bit]])
        self.marked = Bits(order % SAMPLE == 0)
        self.samples = order[order % SAMPLE == 0]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i of the transform."""
        start = np.zeros_like(i)
        for s, level in zip(self.shifts, self.levels):
            one = (symbol >> s & 1).astype(bool)
            a, b = level.rank(start), level.rank(i)
            start, i = np.where(one, level.zeros + a, start - a), np.where(one, level.zeros + b, i - b)
        return i - start

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one symbol longer than that of row i."""
        symbol, start, at = np.zeros_like(i), np.zeros_like(i), i
        for s, level in zip(self.shifts, self.levels):
            one = level.get(at)
            symbol |= one.astype(np.int64) << s
            a, b = level.rank(start), level.rank(at)
            start, at = np.where(one, level.zeros + a, start - a), np.where(one, level.zeros + b, at - b)
        return self.below[symbol] + at - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long patterns: those found, with their first and end rows."""
        which = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.below[-1])
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[which, k]
            lo, hi = self.below[symbol] + self.rank(symbol, lo), self.below[symbol] + self.rank(symbol, hi)
            found = lo < hi
            which, lo, hi = which[found], lo[found], hi[found]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows: steps back to a sampled one."""
        out, at, todo, steps = np.empty_like(rows), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            hit = self.marked.get(at)
            out[todo[hit]] = self.samples[self.marked.rank(at[hit])] + steps
            at, todo = self.back(at[~hit]), todo[~hit]
            steps += 1
        return out


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of the ranges, and for each the index of its range."""
    of = np.repeat(np.arange(len(lo)), hi - lo)
    first = np.cumsum(hi - lo) - (hi - lo)
    return np.arange(len(of)) - first[of] + lo[of], of
