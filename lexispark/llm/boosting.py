"""Gradient-boosted regression trees for two classes, on binned features, with numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Trees of fixed depth as arrays: feature and threshold of each inner node, value of each leaf."""

    def __init__(self, depth: int, bias: float):
        self.depth, self.bias = depth, bias
        self.feature: list[np.ndarray] = []
        self.threshold: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 2.0, penalty: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; splits at quantiles of the features."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees = Trees(depth, float(np.log(share / (1 - share))))
    margin = np.full(n, trees.bias)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-9)
            for f in range(width):
                size = len(cuts[f]) + 1
                if size < 2:
                    continue
                key = local * size + binned[:, f]
                g = np.bincount(key, slope, count * size).reshape(count, size).cumsum(axis=1)
                h = np.bincount(key, curve, count * size).reshape(count, size).cumsum(axis=1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain[(hl < least) | (ht - hl < least)] = -1
                top = gain.argmax(axis=1)
                value = gain[np.arange(count), top]
                for i in np.flatnonzero(value > best):
                    best[i], feature[first + i], threshold[first + i] = value[i], f, cuts[f][top[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        leaves = 2**depth
        value = rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, curve, leaves) + penalty)
        margin += value[leaf]
        trees.feature.append(feature)
        trees.threshold.append(threshold)
        trees.value.append(value)
    return trees
