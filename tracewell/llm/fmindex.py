"""FM-index over sequences of small integers, in numpy, searching many phrases at a time."""

from __future__ import annotations

import numpy as np

#: Every so many positions of a segment the index keeps where in the text a row points; walks are shorter than this.
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Rows of ``text`` in suffix order by prefix doubling. Symbol 0 separates segments: each 0 is smaller than any
    other symbol and than any later 0, so that no comparison runs past a segment. The last symbol is 0.

    Only rows that still tie are sorted again, with twice the depth each time.
    """
    n = len(text)
    ends = text == 0
    count = int(ends.sum())
    start = np.where(ends, np.cumsum(ends) - 1, count + text.astype(np.int64))
    order = np.argsort(start, kind="stable")
    rank = np.empty(n, np.int64)

    def settle(slots: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks rows, whose sorted keys are given, by the first slot of their run; the runs that still tie."""
        fresh = np.empty(len(keys), bool)
        fresh[0] = True
        np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(keys)))
        rank[rows] = np.repeat(slots[heads], sizes)
        tied = np.repeat(sizes > 1, sizes)
        return slots[tied], rows[tied]

    slots, rows = settle(np.arange(n), order, start[order])
    depth = 1
    while len(rows):
        keys = rank[rows] * n + rank[np.minimum(rows + depth, n - 1)]
        by = np.argsort(keys, kind="stable")
        rows = rows[by]
        order[slots] = rows
        slots, rows = settle(slots, rows, keys[by])
        depth *= 2
    return order


class WaveletMatrix:
    """Rank and access on a sequence by one bit vector per bit of its symbols, the highest first."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        values = values.copy()
        for level in range(self.bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(before), before
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[at]
            one = ones[at + 1] > before
            symbol = (symbol << 1) | one
            at = np.where(one, zeros + before, at - before)
        return symbol


class FMIndex:
    """Counts and locates phrases (without symbol 0) in a text of segments that each end with symbol 0."""

    def __init__(self, text: np.ndarray, top: int):
        order = suffix_array(text)
        last = text[order - 1]  # row 0 of the text follows its final 0
        self.n = len(text)
        self.wavelet = WaveletMatrix(last.astype(np.int64), top)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        # a segment's first row is kept too: walks end there, as symbol 0 can't be followed
        kept = (order % SAMPLE == 0) | (last == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept_rows = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[phrases, length] -> the rows of suffixes that start with each phrase, from low to below high."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for i in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, i].astype(np.int64)
            low[live] = self.less[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text that each row points to, walking back to a sampled row."""
        place = np.empty(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            found = self.kept_before[at + 1] > self.kept_before[at]
            place[open_[found]] = self.kept_rows[self.kept_before[at[found]]] + steps
            open_, at = open_[~found], at[~found]
            symbol = self.wavelet.access(at)
            at = self.less[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return place
