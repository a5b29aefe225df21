"""A compressed FM-index over word runs: a wavelet matrix of packed bits with counts per word of bits.

One symbol stands for ``STEP`` consecutive words, and a run is read in ``STEP`` interleaved phases,
so a window of ``STEP * depth`` words is a pattern of ``depth`` symbols. Suffixes are sorted by their
first ``depth`` symbols only: that is as deep as any pattern goes.
"""

from __future__ import annotations

import numpy as np

STEP = 7


def symbols(runs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every place of every run (0 where fewer than ``STEP`` words follow), and the place after each run.

    Each run takes its number of words plus one place. Equal symbols mean equal words: words are
    numbered by a dictionary, and pairs, fours and sevens by the numbers of their parts.
    """
    names: dict[bytes, int] = {}
    flat: list[int] = []
    for r in runs:
        flat += [names.setdefault(w, len(names) + 1) for w in r]
        flat.append(0)
    x = np.array(flat, np.int64)
    ends = np.cumsum([len(r) + 1 for r in runs])
    for shift in (1, 2, 3):  # 2, 4 and 7 words
        after = np.append(x[shift:], np.zeros(shift, np.int64))
        both = np.where((x > 0) & (after > 0), x * (len(flat) + 2) + after, 0)
        found, x = np.unique(both, return_inverse=True)
        x = x + (found[0] != 0)
    # A symbol that would reach past its run holds the 0 after it in one of its parts, and so is 0.
    return x, ends


class FMIndex:
    def __init__(self, runs: list[list[bytes]], weights: np.ndarray, depth: int) -> None:
        self.s, self.ends = symbols(runs)
        n, self.depth = len(self.s), depth
        begins = np.concatenate([[0], self.ends[:-1]])
        run = np.repeat(np.arange(len(runs)), self.ends - begins)
        place = np.arange(n)
        keys = []
        for k in range(depth):
            at = place + STEP * k
            keys.append(np.where(at < self.ends[run], self.s[np.minimum(at, n - 1)], 0))
        order = np.lexsort(keys[::-1])
        before = np.where(order - STEP >= begins[run[order]], self.s[np.maximum(order - STEP, 0)], 0)
        self.weight = np.concatenate([[0], np.cumsum(weights[run[order]])])
        self.levels = max(1, int(self.s.max(initial=0)).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.s, minlength=1 << min(self.levels, 1)))])
        self._build(before)

    def _build(self, x: np.ndarray) -> None:
        self.bits, self.ones, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            b = (x >> level & 1).astype(bool)
            pad = np.zeros(-len(b) % 64 + 64, bool)
            words = np.packbits(np.concatenate([b, pad]), bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(len(b) - int(b.sum()))
            x = np.concatenate([x[~b], x[b]])

    def _rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before ``lo`` and before ``hi``, relative to where its own block starts."""
        start = np.zeros_like(lo)
        ends = [start, lo, hi]
        one = np.uint64(1)
        for k, level in enumerate(reversed(range(self.levels))):
            up = (symbol >> level & 1).astype(bool)
            for j, p in enumerate(ends):
                w = p >> 6
                below = self.bits[k][w] & ((one << (p & 63).astype(np.uint64)) - one)
                r = self.ones[k][w] + np.bitwise_count(below)
                ends[j] = np.where(up, self.zeros[k] + r, p - r)
        return ends[1] - ends[0], ends[2] - ends[0]

    def repeated(self) -> np.ndarray:
        """For every place whether the window that starts there occurs at least twice, by weight.

        Backward search, all windows at once: from the last symbol of each window, one symbol to the
        left per step. A search ends where its interval weighs less than 2; the number of steps it
        lasts is its matching statistic, and windows that last for all are reported.
        """
        last = np.arange(len(self.s)) + STEP * (self.depth - 1)
        run_end = np.repeat(self.ends, np.diff(np.concatenate([[0], self.ends])))
        at = np.nonzero((last < run_end) & (self.s[np.minimum(last, len(self.s) - 1)] > 0))[0]
        c = self.s[at + STEP * (self.depth - 1)]
        lo, hi = self.first[c], self.first[c + 1]
        for k in range(self.depth - 2, -2, -1):
            live = self.weight[hi] - self.weight[lo] >= 2
            at, lo, hi = at[live], lo[live], hi[live]
            if k < 0 or not len(at):
                break
            c = self.s[at + STEP * k]
            a, b = self._rank(c, lo, hi)
            lo, hi = self.first[c] + a, self.first[c] + b
        out = np.zeros(len(self.s), bool)
        out[at] = True
        return out
