"""An FM-index over a shard of symbols: suffix order, Burrows-Wheeler transform in a wavelet matrix, sampled positions.

Everything is numpy and works on many patterns at a time; symbols are integers from 1, and 0 ends the shard.
"""

from __future__ import annotations

import numpy as np

#: Every position divisible by this keeps its place in the suffix order; the others are reached by walking back.
SAMPLE = 16


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Start positions of all suffixes in lexicographic order (prefix doubling; only groups still tied are sorted again)."""
    n = len(text)
    width = max(1, 62 // bits)
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = _tied(head)
    while len(tied):
        at = order[tied]
        group = rank[at]
        key = group * np.int64(n + 1) + rank[np.minimum(at + width, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[_tied(new)]
        width *= 2
    return order


def _tied(head: np.ndarray) -> np.ndarray:
    """Places in groups of more than one, where ``head`` marks the first of each group."""
    last = np.concatenate([head[1:], [True]])
    return np.flatnonzero(~(head & last))


class Bits:
    """A bit vector with rank: ones before a place, from a count for every 64 bits and a popcount inside."""

    def __init__(self, bit: np.ndarray) -> None:
        n = len(bit)
        packed = np.packbits(np.concatenate([bit, np.zeros(64 - n % 64, bit.dtype)]), bitorder="little").view("<u8")
        self.words = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
        self.ones = int(self.before[-1])
        self.n = n

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, inside = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << inside) - np.uint64(1))).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int) -> None:
        """``text``: symbols 1 .. symbols."""
        self.bits = max(1, int(symbols).bit_length())
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_order(text, self.bits)
        last = text[order - 1]  # the first suffix is preceded by the end mark
        counts = np.bincount(text, minlength=symbols + 2)
        #: Suffixes that begin with a smaller symbol.
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = ((last >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(len(bit) - self.levels[-1].ones)
            last = np.concatenate([last[~bit], last[bit]])
        kept = order % SAMPLE == 0
        self.kept = Bits(kept)
        self.kept_positions = order[kept]
        self.n = len(text)

    def occurrences_before(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        start = np.zeros_like(i)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            low, high = self.levels[k].rank(start), self.levels[k].rank(i)
            start = np.where(one, self.zeros[k] + low, start - low)
            i = np.where(one, self.zeros[k] + high, i - high)
        return i - start

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range [low, high) in the suffix order of every pattern (a row, filled up on the right), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for step in range(1, int(lengths.max(initial=0)) + 1):
            alive = alive[(low[alive] < high[alive]) & (lengths[alive] >= step)]
            if not len(alive):
                break
            symbol = patterns[alive, lengths[alive] - step]
            low[alive] = self.smaller[symbol] + self.occurrences_before(symbol, low[alive])
            high[alive] = self.smaller[symbol] + self.occurrences_before(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order: walks back to the next sampled one."""
        out = np.empty(len(places), np.int64)
        open_, at, steps = np.arange(len(places)), places.copy(), 0
        while len(open_):
            hit = self.kept.at(at)
            out[open_[hit]] = self.kept_positions[self.kept.rank(at[hit])] + steps
            open_, at = open_[~hit], self._back(at[~hit])
            steps += 1
        return out

    def _back(self, i: np.ndarray) -> np.ndarray:
        """The place of the suffix that begins one symbol earlier."""
        symbol, start = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for k in range(self.bits):
            one = self.levels[k].at(i)
            low, high = self.levels[k].rank(start), self.levels[k].rank(i)
            start = np.where(one, self.zeros[k] + low, start - low)
            i = np.where(one, self.zeros[k] + high, i - high)
            symbol = (symbol << 1) | one
        return self.smaller[symbol] + i - start
