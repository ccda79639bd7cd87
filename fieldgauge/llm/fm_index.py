"""An FM-index over a sequence of small numbers, for many phrases at once."""

from __future__ import annotations

import numpy as np


def runs_to_separator(seq: np.ndarray) -> np.ndarray:
    """For each place the number of symbols before the next 0 (0 at a 0); the sequence ends with 0."""
    zeros = np.flatnonzero(seq == 0)
    at = np.arange(len(seq))
    return zeros[np.searchsorted(zeros, at)] - at


def suffix_order(seq: np.ndarray, runs: np.ndarray, bits: int) -> np.ndarray:
    """Starts of suffixes in order; a suffix ends at its next 0, and equal ones keep their order.

    The first key packs as many symbols as fit; only ties whose runs go on are sorted further, by
    the rank of what follows, twice as far each time.
    """
    n = len(seq)
    packed = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(packed):
        key <<= bits
        if k < n:
            key[: n - k] |= np.where(runs[: n - k] > k, seq[k:], 0)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = start[np.cumsum(new) - 1]  # the place of the first of the tied
    depth = packed
    while True:
        size = np.diff(np.concatenate([np.unique(rank[order]), [n]]))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        live = order[tied]
        longer = runs[live] >= depth
        # a group stays tied for good once none of its suffixes goes on
        if not longer.any():
            return order
        rest = np.where(longer, rank[np.minimum(live + depth, n - 1)] + 1, 0)
        sub = np.lexsort((live, rest, rank[live]))
        live, rest, group = live[sub], rest[sub], rank[live][sub]
        order[tied] = live
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (rest[1:] != rest[:-1])])
        rank[live] = tied[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        depth *= 2


class FMIndex:
    """Backward search and location over one block of text.

    Symbols are 1 to ``top``; 0 separates and is never searched. The last column of the sorted
    rotations is held as a wavelet tree, a level of bits with running counts for each binary digit.
    Suffix positions are kept at every ``sample``-th place and wherever a run begins, so that a walk
    back never has to cross a separator.
    """

    def __init__(self, seq: np.ndarray, top: int, sample: int = 8):
        self.n = n = len(seq)
        self.bits = max(1, int(top).bit_length())
        order = suffix_order(seq, runs_to_separator(seq), self.bits)
        before = seq[order - 1]  # in front of the first place stands the closing 0
        self.before = before
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        self.ones, self.zeros = [], []
        level = before
        for b in reversed(range(self.bits)):
            bit = (level >> b) & 1
            count = np.empty(n + 1, np.int32)
            count[0] = 0
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(n - int(count[-1]))
            one = bit.astype(bool)
            level = np.concatenate([level[~one], level[one]])
        begins = np.empty(n, bool)
        begins[0] = True
        begins[1:] = seq[:-1] == 0
        kept = (order % sample == 0) | begins[order]
        self.kept_before = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        self.kept, self.places = kept, order[kept]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first ``row`` places of the last column, by the wavelet levels."""
        start, end = np.zeros_like(row), row
        for k, b in enumerate(reversed(range(self.bits))):
            one = ((symbol >> b) & 1).astype(bool)
            s, e = self.ones[k][start], self.ones[k][end]
            start = np.where(one, self.zeros[k] + s, start - s)
            end = np.where(one, self.zeros[k] + e, end - e)
        return end - start

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self.rank(symbol, row)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row after the last) of the phrases that occur; rows of ``phrases`` end-aligned."""
        width = phrases.shape[1]
        alive = np.flatnonzero(lengths > 0)
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(width):
            ended = lengths[alive] == k
            if ended.any():
                done.append((alive[ended], low[ended], high[ended]))
                alive, low, high = alive[~ended], low[~ended], high[~ended]
            symbol = phrases[alive, width - 1 - k].astype(np.int64)
            low, high = self.step(symbol, low), self.step(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
        done.append((alive, low, high))
        return tuple(np.concatenate([d[i] for d in done]) for i in range(3))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of rows, by walking back to a kept one."""
        out = np.empty(len(rows), np.int64)
        left, row, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while left.size:
            here = self.kept[row]
            out[left[here]] = self.places[self.kept_before[row[here]]] + walked
            left, row = left[~here], row[~here]
            row = self.step(self.before[row].astype(np.int64), row)
            walked += 1
        return out
