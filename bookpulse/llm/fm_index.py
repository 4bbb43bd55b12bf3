"""FM-index over integer symbols: suffix array, wavelet tree with rank directories, vectorised backward search and locate."""

from __future__ import annotations

import numpy as np

#: Every how many text positions the suffix array keeps one.
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling: after a step, ranks are right for twice as many symbols. A shorter suffix comes first."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] if step < n else 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]).cumsum()
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n:
            return order
        step *= 2


class Bits:
    """A bit vector with a rank directory: ones before each byte, and a table of ones within one."""

    _within = np.array([[bin(b & ((1 << k) - 1)).count("1") for k in range(8)] for b in range(256)], np.int64)

    def __init__(self, bits: np.ndarray):
        self.packed = np.pad(np.packbits(bits, bitorder="little"), (0, 1))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        return self.before[i >> 3] + self._within[self.packed[i >> 3], i & 7]

    def get(self, i: np.ndarray) -> np.ndarray:
        return self.packed[i >> 3] >> (i & 7).astype(np.uint8) & 1


class Wavelet:
    """Wavelet tree laid out by levels (matrix form): each level holds one bit of every symbol, zeros sorted before ones."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            bit = (text >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            text = np.concatenate([text[~bit], text[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first i."""
        start = np.zeros_like(i)
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            one = (symbol >> (self.levels - 1 - level) & 1).astype(bool)
            r, s = bits.rank(i), bits.rank(start)
            i = np.where(one, zeros + r, i - r)
            start = np.where(one, zeros + s, start - s)
        return i - start

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and how often each stands before."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in zip(self.bits, self.zeros):
            one = bits.get(i).astype(bool)
            r, s = bits.rank(i), bits.rank(start)
            symbol = symbol << 1 | one
            i = np.where(one, zeros + r, i - r)
            start = np.where(one, zeros + s, start - s)
        return symbol, i - start


class FMIndex:
    """Index of ``text``, symbols 1 and up; 0 ends it."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.n, text = len(text) + 1, np.concatenate([text.astype(np.int64), [0]])
        order = suffix_array(text)
        self.tree = Wavelet(text[order - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        sampled = order % SAMPLE == 0
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns at once (rows, right-aligned); gives each one's range of suffixes."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1]):
            symbol = patterns[:, -1 - k]
            on = np.flatnonzero((lengths > k) & (low < high))
            c = symbol[on]
            low[on] = self.first[c] + self.tree.rank(c, low[on])
            high[on] = self.first[c] + self.tree.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking to the sampled position before each."""
        found, walked = np.empty(len(rows), np.int64), 0
        left, at = np.arange(len(rows)), rows.copy()
        while len(left):
            hit = self.sampled.get(at).astype(bool)
            found[left[hit]] = self.positions[self.sampled.rank(at[hit])] + walked
            left, at = left[~hit], at[~hit]
            if len(at):
                symbol, before = self.tree.get(at)
                at = self.first[symbol] + before
            walked += 1
        return found
