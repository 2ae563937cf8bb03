"""An FM-index over a sequence of small integers, in numpy.

The Burrows-Wheeler transform of the sequence is held in a wavelet matrix, which answers rank queries
for all searched phrases at once; phrases are found by backward search and located by walking the
last-to-first map to the next sampled suffix position.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of the sorted suffixes, by doubling the compared length for groups still tied."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    held = seq[order]
    first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, sizes)
    tied = order[np.repeat(sizes > 1, sizes)]
    k = 1
    while len(tied):
        ahead = tied + k
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        group = rank[tied]
        at = np.arange(len(tied))
        new_group = np.r_[True, group[1:] != group[:-1]]
        group_at = np.maximum.accumulate(np.where(new_group, at, 0))
        new_key = np.r_[True, key[1:] != key[:-1]]
        key_at = np.maximum.accumulate(np.where(new_key, at, 0))
        rank[tied] = group + key_at - group_at
        run = np.diff(np.r_[np.flatnonzero(new_key), len(tied)])
        tied = tied[np.repeat(run > 1, run)]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Of seq, whose symbols are 0 .. n_symbols - 1; an end mark that no phrase holds is added."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        text = np.r_[seq.astype(np.int64) + 1, 0]
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n = len(text)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols + 1))]
        self.bits = max(1, int(n_symbols).bit_length())
        self.zeros, self.ones = [], []  # per level: how many bits are 0, and how many 1s lie before each place
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(level) - bit.sum()))
            level = np.r_[level[bit == 0], level[bit == 1]]
        self.sampled = sa % sample == 0
        self.sampled_before = np.r_[0, np.cumsum(self.sampled)]
        self.positions = sa[self.sampled]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        start = np.zeros_like(place)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> b) & 1 == 1
            ones_start, ones_place = self.ones[k][start], self.ones[k][place]
            start = np.where(one, self.zeros[k] + ones_start, start - ones_start)
            place = np.where(one, self.zeros[k] + ones_place, place - ones_place)
        return place - start

    def symbol_and_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place of the transform, and how often it occurs before that place."""
        symbol, start = np.zeros_like(place), np.zeros_like(place)
        for k in range(self.bits):
            ones_start, ones_place = self.ones[k][start], self.ones[k][place]
            one = self.ones[k][place + 1] > ones_place
            symbol = symbol * 2 + one
            start = np.where(one, self.zeros[k] + ones_start, start - ones_start)
            place = np.where(one, self.zeros[k] + ones_place, place - ones_place)
        return symbol, place - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases (one a row, all of one length): first and last + 1 place of each."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j].astype(np.int64) + 1
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Where in the sequence the suffixes at these places start."""
        places = places.astype(np.int64)
        out = np.full(len(places), -1, np.int64)
        live, steps = np.arange(len(places)), 0
        while len(live):
            at = places[live]
            done = self.sampled[at]
            out[live[done]] = self.positions[self.sampled_before[at[done]]] + steps
            live, at = live[~done], at[~done]
            if len(live):
                symbol, rank = self.symbol_and_rank(at)
                places[live] = self.before[symbol] + rank
            steps += 1
        return out
