"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth under logistic loss; each level splits by histograms."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(width)]
        binned = self._bin(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.base)
        self.feature, self.cut, self.value = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, hessian = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            features, cuts = [], []
            for level in range(self.depth):
                f, c = self._split(binned, gradient, hessian, node, 1 << level)
                features.append(f)
                cuts.append(c)
                node = 2 * node + (binned[np.arange(n), f[node]] > c[node])
            leaves = 1 << self.depth
            g, h = (np.bincount(node, weights=w, minlength=leaves) for w in (gradient, hessian))
            value = self.rate * g / (h + self.ridge)
            score += value[node]
            self.feature.append(features)
            self.cut.append(cuts)
            self.value.append(value)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def _split(self, binned, gradient, hessian, node, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.zeros(nodes)
        feature, cut = np.zeros(nodes, dtype=np.int64), np.full(nodes, self.bins, dtype=np.int64)
        for j in range(binned.shape[1]):
            cell = node * self.bins + binned[:, j]
            g, h = (np.bincount(cell, weights=w, minlength=nodes * self.bins).reshape(nodes, -1).cumsum(axis=1) for w in (gradient, hessian))
            total_g, total_h = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + self.ridge) + (total_g - g) ** 2 / (total_h - h + self.ridge) - total_g**2 / (total_h + self.ridge)
            at = gain[:, :-1].argmax(axis=1)
            top = gain[np.arange(nodes), at]
            better = top > best + 1e-9
            best[better], feature[better], cut[better] = top[better], j, at[better]
        return feature, cut

    def probability(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        binned, rows = self._bin(x), np.arange(n)
        score = np.full(n, self.base)
        for features, cuts, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(n, dtype=np.int64)
            for f, c in zip(features, cuts):
                node = 2 * node + (binned[rows, f[node]] > c[node])
            score += value[node]
        return 1 / (1 + np.exp(-score))
