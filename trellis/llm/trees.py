"""Gradient-boosted trees with logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Boosted:
    """Depth-limited trees on quantile bins; a tree is arrays of (feature, threshold, value) in heap order."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 3.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list = []

    def fit(self, x, y):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = sigmoid(f)
            tree = self._grow(binned, edges, p - y, p * (1 - p))
            self.trees.append(tree)
            f += self._tree(tree, x)
        return self

    def _grow(self, binned, edges, g, h):
        n = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.full(n, -1), np.zeros(n), np.zeros(n)
        rows_of = {0: np.arange(len(g))}
        for node in range(n):
            rows = rows_of.pop(node, None)
            if rows is None:
                continue
            G, H = g[rows].sum(), h[rows].sum()
            value[node] = -self.rate * G / (H + self.ridge)
            if node >= 2**self.depth - 1:
                continue
            best = (1e-6, -1, -1)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, k]
                gl, hl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1], np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                gain = gl**2 / (hl + self.ridge) + (G - gl) ** 2 / (H - hl + self.ridge) - G**2 / (H + self.ridge)
                count = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gain[(count < self.least) | (len(rows) - count < self.least)] = -1
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], k, j)
            if best[1] >= 0:
                feature[node], threshold[node] = best[1], edges[best[1]][best[2]]
                left = binned[rows, best[1]] <= best[2]
                rows_of[2 * node + 1], rows_of[2 * node + 2] = rows[left], rows[~left]
        return feature, threshold, value

    def _tree(self, tree, x):
        feature, threshold, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[at]
            go = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]
            at = np.where(go, 2 * at + 1 + right, at)
        return value[at]

    def raw(self, x):
        return self.base + sum((self._tree(t, x) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """The non-decreasing step function of least squares (pool adjacent violators), joined by straight lines."""

    def fit(self, s, y):
        order = np.argsort(s, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, first, last
        for v, t in zip(s[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([t, 1.0, v, v])
            while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
                m, w, _, last = blocks.pop()
                b = blocks[-1]
                b[0], b[1], b[3] = (b[0] * b[1] + m * w) / (b[1] + w), b[1] + w, last
        self.x = np.array([p for b in blocks for p in (b[2], b[3])])
        self.y = np.array([(b[0] * b[1] + 0.05) / (b[1] + 0.1) for b in blocks for _ in (0, 1)])  # never quite 0 or 1
        return self

    def __call__(self, s):
        return np.interp(s, self.x, self.y)
