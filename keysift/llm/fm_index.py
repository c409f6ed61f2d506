"""An FM-index of a shard's words: suffix order, wavelet ranks, backward search and sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; prefixes double in length until no two suffixes tie."""
    n, width = len(codes), 1
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - width, 0)] = rank[width:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) if n else key
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        width *= 2


class WaveletRanks:
    """How often a symbol occurs before a position, from one bit of all symbols at a time."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        symbols = symbols.astype(np.int64)
        for bit in reversed(range(max(1, (alphabet - 1).bit_length()))):
            ones = (symbols >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones)])
            zeros = len(symbols) - int(before[-1])
            self.levels.append((bit, before, zeros))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(at), at
        for bit, before, zeros in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            start = np.where(one, zeros + before[start], start - before[start])
            end = np.where(one, zeros + before[end], end - before[end])
        return end - start


class FmIndex:
    """Index of ``codes``, numbers below ``symbols``; every ``sample``-th position is kept."""

    def __init__(self, codes: np.ndarray, symbols: int, sample: int = 16):
        # A zero of its own ends the text, so all suffixes differ and stepping back keeps their order.
        codes, symbols = np.append(codes + 1, 0), symbols + 1
        order = suffix_order(codes)
        self.before = codes[order - 1]  # the symbol that precedes each suffix, the last one for the first
        self.ranks = WaveletRanks(self.before, symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=symbols))])
        self.kept = order % sample == 0
        self.positions = np.where(self.kept, order, -1)[self.kept]
        self.place = np.cumsum(self.kept) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of suffixes that start with each row of ``phrases``, found from the last word to the first."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.before), np.int64)
        for column in phrases.T[::-1] + 1:
            low = self.first[column] + self.ranks.rank(column, low)
            high = self.first[column] + self.ranks.rank(column, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: step back in the text until a kept position, then count the steps forward."""
        found, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            kept = self.kept[rows]
            found[open_[kept]] = self.positions[self.place[rows[kept]]] + steps
            open_, rows, steps = open_[~kept], rows[~kept], steps + 1
            symbols = self.before[rows]
            rows = self.first[symbols] + self.ranks.rank(symbols, rows)
        return found
