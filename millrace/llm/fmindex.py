"""An FM-index over a sequence of small integers, built and searched with array operations."""

from __future__ import annotations

import numpy as np

from .common import ranges


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Zeros are separators: each sorts below all else and differs from the others."""
    n = len(seq)
    zero = seq == 0
    rank = np.where(zero, np.cumsum(zero), seq.astype(np.int64) + int(zero.sum()))
    h = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] if h < n else 0
        key = rank * (int(rank.max(initial=0)) + int(after.max(initial=0)) + 1) + after if h < n else rank
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.r_[1, key[order][1:] != key[order][:-1]]) if n else np.empty(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n or h >= n:
            return order
        h *= 2


class WaveletMatrix:
    """Rank of any symbol in any prefix, a bit of the symbol per level."""

    def __init__(self, seq: np.ndarray):
        self.levels = max(1, int(seq.max(initial=0)).bit_length())
        self.zeros, self.n_zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.zeros.append(np.r_[0, np.cumsum(bit == 0)].astype(np.int32))
            self.n_zeros.append(int(self.zeros[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(at)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            z_at, z_start = self.zeros[k][at], self.zeros[k][start]
            at = np.where(one, self.n_zeros[k] + at - z_at, z_at)
            start = np.where(one, self.n_zeros[k] + start - z_start, z_start)
        return at - start


class FmIndex:
    """Backward search and location of phrases in one shard."""

    def __init__(self, seq: np.ndarray, sample: int = 8):
        """seq: integers; 0 separates runs, ends the sequence, and is in no phrase."""
        order = suffix_order(seq)
        self.bwt = seq[order - 1]
        self.wavelet = WaveletMatrix(self.bwt)
        self.below = np.r_[0, np.cumsum(np.bincount(seq, minlength=int(seq.max(initial=0)) + 2))].astype(np.int64)
        #: A place is kept for every sample-th position and for each run's start, which no step crosses.
        kept = (order % sample == 0) | (self.bwt == 0)
        self.place = order[kept].astype(np.int32 if len(order) < 1 << 31 else np.int64)
        bits = np.packbits(np.r_[kept, np.zeros(-len(kept) % 64, bool)], bitorder="little").view(np.uint64)
        self.kept, self.before = bits, np.r_[0, np.cumsum(np.bitwise_count(bits))]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase (a row of symbols above 0); empty if it doesn't occur."""
        lo, hi = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        alive = np.flatnonzero((phrases < len(self.below) - 1).all(axis=1))
        a, b = self.below[phrases[alive, -1]], self.below[phrases[alive, -1] + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            go = a < b
            alive, a, b = alive[go], a[go], b[go]
            c = phrases[alive, k]
            a, b = self.below[c] + self.wavelet.rank(c, a), self.below[c] + self.wavelet.rank(c, b)
        lo[alive], hi[alive] = a, b
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of each row, by steps back to a kept one."""
        out, left, row, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(left):
            bits, bit = self.kept[row >> 6], (row & 63).astype(np.uint64)
            found = (bits >> bit) & np.uint64(1) > 0
            nth = self.before[row >> 6] + np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[found]] = self.place[nth[found]] + steps
            left, row = left[~found], row[~found]
            c = self.bwt[row]
            row = self.below[c] + self.wavelet.rank(c, row)
            steps += 1
        return out

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which phrase, position) of every occurrence."""
        lo, hi = self.search(phrases)
        return np.repeat(np.arange(len(phrases)), hi - lo), self.locate(ranges(lo, hi - lo))
