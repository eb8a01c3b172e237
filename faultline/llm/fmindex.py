"""An FM-index over a sequence of small integers, in numpy: suffix array by
prefix doubling, Burrows-Wheeler transform in a wavelet matrix, backward search
and location through sampled suffix positions, for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of ``text``; zeros are separators, each its own symbol below all others."""
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    _, rank = np.unique(rank, return_inverse=True)
    order, k = np.argsort(rank, kind="stable"), 1
    while n and int(rank.max()) < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        k *= 2
    return order


class FMIndex:
    """``text`` holds symbols from 1 and zeros between pieces that matches never cross; it ends with a zero."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_array(text)
        before = text[order - 1]
        before[order == 0] = 0
        self.before = before
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        # Sampled: every SAMPLE-th position and the first of each piece, so a walk never crosses a zero.
        self.sampled = (order % self.SAMPLE == 0) | (before == 0)
        self.samples = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.levels: list[tuple[int, int, np.ndarray]] = []
        level = before
        for bit in reversed(range(max(1, int(symbols).bit_length()))):
            ones = (level >> bit) & 1
            counts = np.zeros(len(level) + 1, np.int64)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((bit, len(level) - int(counts[-1]), counts))
            level = np.concatenate([level[ones == 0], level[ones == 1]])

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``row`` transformed symbols."""
        low, high = np.zeros_like(row), row
        for bit, zeros, counts in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            low = np.where(one, zeros + counts[low], low - counts[low])
            high = np.where(one, zeros + counts[high], high - counts[high])
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns of one length (a row each), by backward search."""
        last = patterns[:, -1]
        low, high = self.smaller[last], self.smaller[last + 1]
        live = np.flatnonzero(low < high)
        for j in range(patterns.shape[1] - 2, -1, -1):
            s = patterns[live, j]
            a, b = self.smaller[s] + self.rank(s, low[live]), self.smaller[s] + self.rank(s, high[live])
            low[live], high[live] = a, b
            live = live[a < b]
        none = np.ones(len(low), bool)
        none[live] = False
        high[none] = low[none]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to the next sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            done = self.sampled[at]
            out[todo[done]] = self.samples[self.sample_rank[at[done]]] + steps[todo[done]]
            todo, at = todo[~done], at[~done]
            s = self.before[at]
            rows[todo] = self.smaller[s] + self.rank(s, at)
            steps[todo] += 1
        return out
