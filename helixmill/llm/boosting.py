"""A small gradient-boosted tree classifier in numpy, with Platt calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, histogram splits on at most ``bins`` thresholds a feature."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.scale, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-margin))
            tree = self._tree(codes, edges, prob - y, prob * (1 - prob))
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _tree(self, codes, edges, g, h):
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(g), int)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -self.rate * gs / (hs + 1)
            if node >= nodes // 2 or len(rows) < 10:
                continue
            best, gain = None, 1e-6
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                c = codes[f, rows]
                gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                s = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                k = int(s.argmax())
                if s[k] > gain:
                    best, gain = (f, k), s[k]
            if best:
                f, k = best
                feature[node], cut[node] = f, edges[f][k]
                at[rows] = 2 * node + 1 + (codes[f, rows] > k)
        return feature, cut, value

    def _walk(self, tree, x):
        feature, cut, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[at]
            go = f >= 0
            at[go] = 2 * at[go] + 1 + (x[go, f[go]] > cut[at[go]])
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on rows kept out of the fit."""
        m = self.margin(x)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * m + b)))
            g, w = p - target, np.maximum(p * (1 - p), 1e-9)
            grad = np.array([(g * m).sum() + 1e-3 * (a - 1), g.sum()])
            hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-9]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
        self.scale, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.margin(x) + self.shift)))
