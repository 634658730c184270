"""An FM-index over a sequence of symbols: suffix order, wavelet-matrix ranks, sampled positions.

Symbol 0 separates runs; the searched phrases hold symbols from 1 upwards.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of `symbols`, which ends with 0. Separators are taken as distinct, in
    the order of their places, so a comparison never goes beyond a run. Three symbols are
    sorted at once; later rounds double that and touch only what is still tied."""
    n = len(symbols)
    seps = symbols == 0
    key = np.where(seps, np.cumsum(seps) - 1, symbols.astype(np.int64) + int(seps.sum()))
    bits = int(key.max()).bit_length()
    take = max(1, 62 // bits) if n > 1 else 1
    packed = key.copy()
    for j in range(1, take):
        packed = packed << bits
        if j < n:
            packed[: n - j] |= key[j:]
    order = np.argsort(packed, kind="stable")
    ranked = packed[order]
    head = np.ones(n, bool)
    head[1:] = ranked[1:] != ranked[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    depth = take
    while True:
        after = np.append(head[1:], True)
        tied = np.flatnonzero(~(head & after))
        if not len(tied):
            return order
        at = order[tied]
        key = first[tied] * n + rank[np.minimum(at + depth, n - 1)]
        by = np.argsort(key, kind="stable")
        order[tied], key = at[by], key[by]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        head[tied] = fresh
        first[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[order[tied]] = first[tied]
        depth *= 2


class Bits:
    """A bit vector with constant-time rank: 64-bit words and their running counts."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros((len(flags) // 64 + 1) * 64, np.uint8)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        w, b = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        v = values
        for level in range(self.depth - 1, -1, -1):
            flags = ((v >> level) & 1).astype(bool)
            self.levels.append((Bits(flags), int(len(v) - flags.sum())))
            v = np.concatenate([v[~flags], v[flags]])
        self.begin = self._down(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (bits, zeros), level in zip(self.levels, range(self.depth - 1, -1, -1), strict=True):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of `symbol` before place `i`."""
        return self._down(symbol, i) - self.begin[symbol]

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place `i`, and its occurrences before."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in self.levels:
            bit = bits.get(i).astype(np.int64)
            ones = bits.rank(i)
            i = np.where(bit == 1, zeros + ones, i - ones)
            symbol = symbol << 1 | bit
        return symbol, i - self.begin[symbol]


class FMIndex:
    """Counts and places of phrases in `symbols` (ends with 0); suffix positions are kept
    for every `sample`-th place and for each run's first, so a walk never leaves a run."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 8):
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.n = len(symbols)
        self.wavelet = WaveletMatrix(before.astype(np.int64), sigma)
        self.less = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=sigma + 1), out=self.less[1:])
        kept = (order % sample == 0) | (before == 0)
        self.kept, self.places = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of each phrase, a row of `phrases` filled from the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            if not len(live):
                break
            c = phrases[live, lengths[live] - step]
            low[live] = self.less[c] + self.wavelet.rank(c, low[live])
            high[live] = self.less[c] + self.wavelet.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix ranks, walked back to the next kept position."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.kept.get(at[live]).astype(bool)
            d = live[done]
            out[d] = self.places[self.kept.rank(at[d])] + steps[d]
            live = live[~done]
            if len(live):
                symbol, occ = self.wavelet.get(at[live])
                at[live] = self.less[symbol] + occ
                steps[live] += 1
        return out
