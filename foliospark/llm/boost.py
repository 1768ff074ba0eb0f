"""Gradient-boosted trees for two classes on NumPy arrays: small models trained on bounded samples, sent to tasks whole."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, Newton leaves, trees of fixed depth over quantile bins. Rows with NaN go to the left."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, reg: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.reg = rounds, depth, rate, bins, reg
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _cuts(self, v: np.ndarray) -> np.ndarray:
        """Between all values where there are few, for a rare flag lies beyond every quantile."""
        u = np.unique(v[~np.isnan(v)])
        return (u[1:] + u[:-1]) / 2 if len(u) <= self.bins else np.unique(np.quantile(u, np.linspace(0, 1, self.bins + 1)[1:-1]))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), -np.inf, x)
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.cuts = [self._cuts(x[:, j]) for j in range(x.shape[1])]
        b = self._binned(x)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        size = self.bins + 1
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob) + 1e-9
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, size)
            at = np.zeros(len(y), int)  # place in the heap of nodes
            for level in range(self.depth):
                first = 2**level - 1
                for node in range(first, first + 2**level):
                    rows = np.flatnonzero(at == node)
                    if len(rows) < 8:
                        continue
                    gs, hs, best = g[rows], h[rows], (1e-6, 0, size)
                    total = gs.sum() ** 2 / (hs.sum() + self.reg)
                    for j in range(x.shape[1]):
                        bj = b[rows, j]
                        gl, hl = np.cumsum(np.bincount(bj, gs, size)), np.cumsum(np.bincount(bj, hs, size))
                        gain = gl**2 / (hl + self.reg) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + self.reg) - total
                        k = int(np.argmax(gain[:-1]))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), j, k)
                    feature[node], cut[node] = best[1], best[2]
                at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.reg)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive class."""
        x = np.asarray(x, float)
        if not len(x):
            return np.zeros(0)
        b, out, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out
