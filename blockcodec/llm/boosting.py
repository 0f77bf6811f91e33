"""Gradient-boosted trees for two classes, on numpy histograms."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    edges: list[np.ndarray]  # by feature
    base: float = 0.0
    #: (feature, bin, values) by tree: complete binary trees, level by level.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int16) if len(x) else np.zeros((0, len(self.edges)), np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range((len(value)).bit_length() - 1):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least: float = 2.0) -> Boosted:
    """Second-order boosting of the log-loss. Each node takes the best split of
    its histogram of gradients; a node without a gain sends all rows left."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(edges, float(np.log(p / (1 - p))))
    b, (n, d) = model.binned(x), x.shape
    margin = np.full(n, model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        size = 2**depth - 1
        feature, cut, node = np.zeros(size, np.int64), np.full(size, BINS, np.int64), np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = node - first
            hist = np.zeros((2, d, wide, BINS + 1))
            for j in range(d):
                at = local * (BINS + 1) + b[:, j]
                hist[0, j] = np.bincount(at, g, wide * (BINS + 1)).reshape(wide, -1)
                hist[1, j] = np.bincount(at, h, wide * (BINS + 1)).reshape(wide, -1)
            left = hist.cumsum(axis=3)[..., :-1]
            whole = hist.sum(axis=3, keepdims=True)
            right = whole - left
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
            gain[(left[1] < least) | (right[1] < least)] = 0
            flat = gain.transpose(1, 0, 2).reshape(wide, -1)
            best = flat.argmax(axis=1)
            good = flat[np.arange(wide), best] > 1e-6
            feature[first : first + wide] = np.where(good, best // BINS, 0)
            cut[first : first + wide] = np.where(good, best % BINS, BINS)
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = node - size
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        margin += value[leaf]
        model.trees.append((feature, cut, value))
    return model
