"""Gradient-boosted regression trees for two classes, on binned numpy features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, histogram splits, trees of fixed depth in arrays (node k has 2k+1 and 2k+2)."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 10, l2: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2
        self.features = self.cuts = self.values = None
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rows, wide = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(wide)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(wide)], 1)  # x <= edge k <=> bin <= k
        flat = binned + np.arange(wide) * self.bins
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.features = np.zeros((self.n, inner), np.int64)
        self.cuts = np.full((self.n, inner), np.inf)
        self.values = np.zeros((self.n, leaves))
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        f = np.full(rows, self.start)
        for t in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(rows, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(first, 2 * first + 1):
                    mine = np.flatnonzero(node == k)
                    if len(mine) >= 2 * self.least:
                        self._split(t, k, flat[mine], g[mine], h[mine], edges, wide)
                node = 2 * node + 1 + (x[np.arange(rows), self.features[t, node]] > self.cuts[t, node])
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
            self.values[t] = self.rate * gs / (hs + self.l2)
            f += self.values[t, leaf]
        return self

    def _split(self, t: int, k: int, flat: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list, wide: int) -> None:
        size = wide * self.bins
        at = flat.ravel()
        sums = [np.bincount(at, np.repeat(w, wide), size).reshape(wide, self.bins).cumsum(1) for w in (g, h, np.ones(len(g)))]
        gl, hl, nl = sums
        gr, hr, nr = g.sum() - gl, h.sum() - hl, len(g) - nl
        gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - g.sum() ** 2 / (h.sum() + self.l2)
        gain[(nl < self.least) | (nr < self.least)] = 0
        for j in range(wide):
            gain[j, len(edges[j]) :] = 0
        best = int(gain.argmax())
        if gain.flat[best] > 1e-6:
            j, b = divmod(best, self.bins)
            self.features[t, k], self.cuts[t, k] = j, edges[j][b]

    def logits(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), 2**self.depth - 1
        for features, cuts, values in zip(self.features, self.cuts, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
            f += values[node - inner]
        return f
