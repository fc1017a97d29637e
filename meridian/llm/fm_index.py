"""A compressed full-text index over sequences of 64-bit word hashes.

The Burrows-Wheeler transform of all pieces stands in a wavelet matrix: one row of packed bits for each
bit of a word's number, with counts before every 64th. Backward search walks these rows for many
patterns at once. Pieces end in terminators of their own, so no match runs over an end.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of whole numbers from 0 on, by doubling; a shorter suffix comes first."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (max(n, int(rank.max(initial=0))) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        rank = new
        if not n or rank[order[-1]] == n - 1:
            return order
        step *= 2


class _Bits:
    """Packed bits that count their ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words)
        self.before = (np.cumsum(ones, dtype=np.int64) - ones).astype(np.int32)
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below).astype(np.int64)


class FmIndex:
    """``pieces``: word hashes one after another, ``sizes`` of each, and how often each ``counts``."""

    def __init__(self, pieces: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.words = np.unique(pieces)
        n, ends = len(pieces) + len(sizes), np.cumsum(sizes + 1) - 1
        text = np.empty(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = np.searchsorted(self.words, pieces) + len(sizes)
        text[ends] = np.arange(len(sizes))  # every terminator is a number of its own: the order is one of whole suffixes
        order = suffix_array(text)
        symbols = np.maximum(text - len(sizes) + 1, 0)
        bwt = symbols[order - 1]
        numbers = np.arange(len(self.words) + 2)
        self.first = np.searchsorted(np.sort(bwt), numbers)
        self.total = np.concatenate([[0], np.cumsum(np.repeat(counts, sizes + 1)[order])])
        self.levels: list[_Bits] = []
        self.depth = max(1, int(len(self.words)).bit_length())
        for level in range(self.depth - 1, -1, -1):
            one = (bwt >> level & 1).astype(bool)
            self.levels.append(_Bits(one))
            bwt = np.concatenate([bwt[~one], bwt[one]])
        found, where = np.unique(bwt, return_index=True)
        self.start = np.zeros(len(numbers), np.int64)
        self.start[found] = where

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words from 1 on; 0 for a word that no piece has."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at + 1, 0)

    def extend(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that begin with the word and go on as before."""
        low, high = low.copy(), high.copy()
        for bits, level in zip(self.levels, range(self.depth - 1, -1, -1), strict=True):
            one = (number >> level & 1).astype(bool)
            below, above = bits.ones(low), bits.ones(high)
            low = np.where(one, bits.zeros + below, low - below)
            high = np.where(one, bits.zeros + above, high - above)
        shift = self.first[number] - self.start[number]
        return low + shift, high + shift

    def reach(self, numbers: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
        """For each stretch the smallest start from which on, up to its end, it occurs ``least`` times: its matching statistic."""
        at = ends.copy()
        live = np.flatnonzero(at > begins)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.total) - 1)
        while len(live):
            number = numbers[at[live] - 1]
            low, high = self.extend(number, low, high)
            good = (number > 0) & (high > low)
            good &= self.total[np.where(good, high, 0)] - self.total[np.where(good, low, 0)] >= least
            live, low, high = live[good], low[good], high[good]
            at[live] -= 1
            more = at[live] > begins[live]
            live, low, high = live[more], low[more], high[more]
        return at

    def repeated(self, words: np.ndarray, sizes: np.ndarray, width: int, least: int = 2) -> np.ndarray:
        """For every word of the streamed documents, whether the ``width`` words from it on, of one document, occur ``least`` times.

        One search from a document's end settles all windows inside its longest match; every other window
        is searched from its own end, and most searches stop after a few words.
        """
        numbers, ends = self.numbers(words), np.cumsum(sizes)
        begins = ends - sizes
        at = self.reach(numbers, begins, ends, least)
        places, last = np.arange(len(words)), np.repeat(ends, sizes) - width
        inside = places <= last
        out = inside & (places >= np.repeat(at, sizes))
        open_ = np.flatnonzero(inside & ~out)
        for some in np.array_split(open_, len(open_) // 100_000 + 1):
            out[some] = self.reach(numbers, some, some + width, least) == some
        return out
