"""An FM-index over integer symbols, vectorised over many phrases at once."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; seq must end in a symbol smaller than all others."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, 2 * step


class FMIndex:
    """Of seq (symbols 0 or more). Levels of a wavelet tree, stored in the level-wise order in which each level's zeros come
    first, answer rank; every sample-th suffix position is kept for locate."""

    def __init__(self, seq: np.ndarray, sample: int = 8):
        text = np.concatenate([np.asarray(seq, np.int64) + 1, [0]])
        order = suffix_array(text)
        last = text[order - 1]
        self.n, self.symbols = len(text), int(text.max()) + 1
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.bits = max(1, int(self.symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        level = last
        for k in range(self.bits - 1, -1, -1):
            bit = (level >> k & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            level = np.concatenate([level[~bit], level[bit]])
        self.last = last
        self.marked = order % sample == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.kept = order[self.marked]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the last column before each position."""
        begin, end = np.zeros(len(symbol), np.int64), at.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin, end = np.where(bit, zeros + b, begin - b), np.where(bit, zeros + e, end - e)
        return end - begin

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search for phrases (rows of equal length): the suffix ranges [low, high)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k].astype(np.int64) + 1
            known = (symbol > 0) & (symbol < self.symbols) & (low < high)
            symbol = np.where(known, symbol, 0)
            base = self.smaller[symbol]
            low, high = np.where(known, base + self.rank(symbol, low), 0), np.where(known, base + self.rank(symbol, high), 0)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in seq of suffix rows, by walking back to the next sampled one."""
        rows, steps, found = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.marked[at]
            found[open_[hit]] = self.kept[self.mark_rank[at[hit]]] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
            symbol = self.last[at]
            rows[open_] = self.smaller[symbol] + self.rank(symbol, at)
            steps[open_] += 1
        return found
