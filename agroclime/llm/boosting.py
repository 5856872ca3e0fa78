"""Gradient-boosted regression trees with logistic loss, for small dense training sets."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier; every split tries all distinct values of every feature."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.l2, self.least = trees, depth, rate, l2, least
        self.start, self.forest = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        w = np.ones(len(y)) if weight is None else weight
        share = float(np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, w * (y - p), w * p * (1 - p), np.arange(len(y)), self.depth)
            self.forest.append(tree)
            score += self._value(tree, x)
        return self

    def _grow(self, x, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = self.rate * gs / (hs + self.l2)
        best = (1e-6, None, None)
        if depth:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, gl, hl = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                gain[(v[1:] == v[:-1]) | (hl < self.least) | (hs - hl < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] is None:
            return float(leaf)
        low = x[rows, best[1]] <= best[2]
        return best[1], float(best[2]), self._grow(x, g, h, rows[low], depth - 1), self._grow(x, g, h, rows[~low], depth - 1)

    def _value(self, tree, x) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._value(low, x), self._value(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.forest:
            score += self._value(tree, x)
        return 1 / (1 + np.exp(-score))
