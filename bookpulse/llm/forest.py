"""A random forest for 0/1 labels on numeric features: bootstrap rows, random features a split, Gini gain; numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays: feature (-1: leaf), threshold (left if <=), left and right child, share of label 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            low = x[rows, self.feature[node]] <= self.threshold[node]
            at[rows] = np.where(low, self.left[node], self.right[node])
        return self.share[at]


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[float, int, float]:
    """(gain, feature, threshold) with the largest fall of Gini impurity; first feature, lowest threshold on ties."""
    n, ones = len(y), y.sum()
    best = (0.0, -1, 0.0)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        left, k = cut + 1, c[cut]
        right, j = n - left, ones - k
        gain = k * k / left + (left - k) ** 2 / left + j * j / right + (right - j) ** 2 / right - (ones * ones + (n - ones) ** 2) / n
        i = int(gain.argmax())
        if gain[i] > best[0] + 1e-12:
            best = (float(gain[i]), int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, random: np.random.Generator, depth: int, least: int, tried: int) -> Tree:
    nodes: list[list] = []

    def add(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
        if level < depth and len(rows) >= 2 * least and 0 < nodes[at][4] < 1:
            gain, f, t = _best_split(x[rows], y[rows], random.choice(x.shape[1], tried, replace=False))
            if f >= 0:
                low = x[rows, f] <= t
                if least <= low.sum() <= len(rows) - least:
                    nodes[at][:2] = f, t
                    nodes[at][2] = add(rows[low], level + 1)
                    nodes[at][3] = add(rows[~low], level + 1)
        return at

    add(random.integers(0, len(y), len(y)), 0)
    return Tree(*(np.array(c) for c in zip(*nodes)))


@dataclass
class Forest:
    trees: list[Tree]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 over the trees."""
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 11) -> Forest:
    random = np.random.default_rng(seed)
    tried = max(1, int(np.sqrt(x.shape[1]) + 1))
    return Forest([grow(x, y.astype(np.float64), random, depth, least, tried) for _ in range(trees)])
