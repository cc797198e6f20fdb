"""Gradient-boosted trees for two classes, small and vectorised: fitted on the driver, applied in tasks."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Logistic boosting with complete trees of one depth; splits are taken over quantile bins."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, least: float = 1.0):
        self.n_trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.features = np.zeros((0, 2**depth - 1), np.int64)
        self.thresholds = np.zeros((0, 2**depth - 1))
        self.leaves = np.zeros((0, 2**depth))
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, d = x.shape
        weight = np.ones(n) if weight is None else weight
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        mean = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.start)
        features, thresholds, leaves = [], [], []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            f, t, values, leaf = self._tree(bins, edges, grad, hess)
            features.append(f)
            thresholds.append(t)
            leaves.append(values)
            score += values[leaf]
        self.features, self.thresholds, self.leaves = np.array(features), np.array(thresholds), np.array(leaves)
        return self

    def _tree(self, bins, edges, grad, hess):
        d, inner = bins.shape[1], 2**self.depth - 1
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)  # an unsplit node sends all rows left
        node = np.zeros(len(bins), np.int64)
        for level in range(self.depth):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            place = node - base
            for j in range(d):
                cell = place * BINS + bins[:, j]
                g = np.bincount(cell, grad, width * BINS).reshape(width, BINS)
                h = np.bincount(cell, hess, width * BINS).reshape(width, BINS)
                gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < self.least) | (ht - hl < self.least)] = 0
                cut = gain[:, : len(edges[j])]
                if not cut.shape[1]:
                    continue
                at = cut.argmax(axis=1)
                top = cut[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[base:base + width][better] = j
                threshold[base:base + width][better] = edges[j][at[better]]
            right = np.zeros(len(bins), bool)
            for k in range(width):
                rows = place == k
                if np.isfinite(threshold[base + k]):
                    j = feature[base + k]
                    right[rows] = bins[rows, j] > np.searchsorted(edges[j], threshold[base + k], side="left")
            node = 2 * node + 1 + right
        leaf = node - inner
        values = self.rate * np.bincount(leaf, grad, 2**self.depth) / (np.bincount(leaf, hess, 2**self.depth) + 1)
        return feature, threshold, values, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out
