"""Gradient-boosted decision trees for yes-no questions, in numpy: features in equal-count bins, one depth for all trees."""

from __future__ import annotations

import numpy as np


class Boosted:
    """``trees`` full binary trees of ``depth`` levels fitted to the logistic loss; ``score`` gives log-odds."""

    def __init__(self, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.2, least: float = 8.0, ridge: float = 1.0):
        self.trees, self.depth, self.bins, self.rate, self.least, self.ridge = trees, depth, bins, rate, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(column, quantiles)) for column in x.T]
        binned = self._bin(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.limit = np.full((self.trees, inner), self.bins, np.int64)
        self.value = np.zeros((self.trees, 1 << self.depth))
        score = np.full(len(y), self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                local = node - first
                total_g, total_w = np.bincount(local, gradient, width), np.bincount(local, weight, width)
                for f in range(x.shape[1]):
                    cell = local * self.bins + binned[:, f]
                    g = np.bincount(cell, gradient, width * self.bins).reshape(width, self.bins).cumsum(axis=1)[:, :-1]
                    w = np.bincount(cell, weight, width * self.bins).reshape(width, self.bins).cumsum(axis=1)[:, :-1]
                    rest_g, rest_w = total_g[:, None] - g, total_w[:, None] - w
                    gain = g * g / (w + self.ridge) + rest_g * rest_g / (rest_w + self.ridge) - (total_g * total_g / (total_w + self.ridge))[:, None]
                    gain[(w * 4 < self.least) | (rest_w * 4 < self.least)] = -1
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    self.feature[t, first:first + width][better] = f
                    self.limit[t, first:first + width][better] = at[better]
                node = 2 * node + 1 + (binned[np.arange(len(y)), self.feature[t, node]] > self.limit[t, node])
            leaf = node - inner
            g, w = np.bincount(leaf, gradient, 1 << self.depth), np.bincount(leaf, weight, 1 << self.depth)
            self.value[t] = self.rate * g / (w + self.ridge)
            score += self.value[t, leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(x):
            binned, rows = self._bin(x), np.arange(len(x))
            for t in range(self.trees):
                node = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (binned[rows, self.feature[t, node]] > self.limit[t, node])
                out += self.value[t, node - self.value.shape[1] + 1]
        return out
