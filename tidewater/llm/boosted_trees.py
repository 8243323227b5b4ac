"""Gradient-boosted trees for a yes/no label: histogram splits, complete trees of a fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """``feature`` and ``threshold`` of the inner nodes (trees x 2^depth - 1, level by level) and the
    ``leaf`` values; a row goes right where its feature lies above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0,
        min_weight: float = 2.0) -> Forest:
    """Newton boosting of the log loss; splits at up to ``bins`` quantiles of each feature."""
    n, width = x.shape
    if not n:
        x, y, n = np.zeros((1, width)), np.full(1, 0.5), 1
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(width) * bins
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    forest = Forest(np.zeros((trees, 2 ** depth - 1), np.int64), np.full((trees, 2 ** depth - 1), np.inf), np.zeros((trees, 2 ** depth)),
                    float(np.log(share / (1 - share))), depth)
    margin = np.full(n, forest.base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, weight = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            key = ((at - first)[:, None] * (width * bins) + flat).ravel()
            g = np.bincount(key, np.repeat(grad, width), count * width * bins).reshape(count, width, bins).cumsum(2)
            h = np.bincount(key, np.repeat(weight, width), count * width * bins).reshape(count, width, bins).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g * g / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt * gt / (ht + ridge)
            gain[(h < min_weight) | (ht - h < min_weight)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for i, b in enumerate(best.tolist()):
                j, cut = divmod(b, bins)
                if gain[i, j, cut] > 1e-6 and cut < len(cuts[j]):
                    forest.feature[k, first + i], forest.threshold[k, first + i] = j, cuts[j][cut]
            f, t = forest.feature[k], forest.threshold[k]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - (2 ** depth - 1)
        forest.leaf[k] = rate * np.bincount(leaf, grad, 2 ** depth) / (np.bincount(leaf, weight, 2 ** depth) + ridge)
        margin += forest.leaf[k][leaf]
    return forest
