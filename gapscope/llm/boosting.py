"""Gradient-boosted regression trees for a binary label, in numpy, over quantile bins."""
from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Logistic boosting with trees of fixed depth; a tree is arrays of feature, cut and leaf values by heap position."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 2.0):
        self.n_trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            prob = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, cuts, y - prob, prob * (1 - prob))
            self.trees.append(tree)
            raw += self._apply(tree, x)
        return self

    def _grow(self, binned, cuts, grad, hess):
        inner, leaves = 2 ** self.depth - 1, 2 ** self.depth
        feature, cut = np.full(inner, -1), np.full(inner, np.inf)
        at = np.zeros(len(grad), np.int64)
        for level in range(self.depth):
            for node in range(2 ** level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                best = (1e-6, -1, 0)
                if len(rows) > 1:
                    g, h = grad[rows], hess[rows]
                    whole = g.sum() ** 2 / (h.sum() + 1)
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, j], g, len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, j], h, len(c) + 1))[:-1]
                        gain = gl ** 2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                        gain[(hl < self.least * 0.05) | (h.sum() - hl < self.least * 0.05)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), j, k)
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], cuts[best[1]][best[2]]
                    right = binned[rows, best[1]] > best[2]
                else:
                    right = np.zeros(len(rows), bool)
                at[rows] = 2 * node + 1 + right
        values = np.zeros(leaves)
        leaf = at - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        values = self.rate * g / (h + 1)
        return feature, cut, values

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, values = tree
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            at = 2 * at + 1 + (x[rows, f] > cut[at])
        return values[at - (2 ** self.depth - 1)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for tree in self.trees:
            raw += self._apply(tree, x)
        return 1 / (1 + np.exp(-raw))
