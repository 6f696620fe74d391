"""Gradient-boosted regression trees and isotonic calibration in numpy, for dense features of a few dozen columns."""

from __future__ import annotations

import numpy as np


def quantile_edges(x: np.ndarray, bins: int = 48) -> list[np.ndarray]:
    """For each column, up to ``bins`` - 1 inner bin edges at its quantiles."""
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


class Boosted:
    """Binary logistic boosting with second-order histogram splits on trees of a fixed depth."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 2.0, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.l2, self.least = rounds, depth, rate, l2, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = quantile_edges(x)
        width = max(len(e) for e in edges) + 1
        binned = np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)])
        n, columns = binned.shape
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(n, self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            gradient, hessian = q - y, q * (1 - q)
            node = np.zeros(n, np.int64)
            feature = np.full(2**self.depth - 1, -1)
            limit = np.zeros(2**self.depth - 1)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                slot = node - first
                g = np.stack([np.bincount(slot * width + binned[:, j], gradient, count * width).reshape(count, width) for j in range(columns)], 1).cumsum(2)
                h = np.stack([np.bincount(slot * width + binned[:, j], hessian, count * width).reshape(count, width) for j in range(columns)], 1).cumsum(2)
                all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + self.l2) + (all_g - g) ** 2 / (all_h - h + self.l2) - all_g**2 / (all_h + self.l2)
                gain[(h < self.least / 4) | (all_h - h < self.least / 4)] = 0
                for k in range(count):
                    j, b = np.unravel_index(gain[k].argmax(), gain[k].shape)
                    if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                        feature[first + k], limit[first + k] = j, edges[j][b]
                node = self._step(x, node, feature, limit)
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, gradient, 2**self.depth) / (np.bincount(leaf, hessian, 2**self.depth) + self.l2)
            margin += value[leaf]
            self.trees.append((feature, limit, value))
        return self

    @staticmethod
    def _step(x, node, feature, limit):
        """Rows go left where a node has no split or the value lies below its limit."""
        f = feature[node]
        right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] >= limit[node])
        return 2 * node + 1 + right

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = self._step(x, node, feature, limit)
            out += value[node - (2**self.depth - 1)]
        return out


class Isotonic:
    """The non-decreasing step function nearest to the labels (pool adjacent violators), with linear interpolation.

    Each block is shrunk a little to the overall rate, so that scores stay inside (0, 1)."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        rate = float(y.mean()) if len(y) else 0.5
        blocks: list[list[float]] = []  # weight, sum of labels, sum of margins
        for m, t in zip(margin[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([1.0, t, m])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.at = np.array([m / w for w, _, m in blocks] or [0.0])
        self.value = np.array([(s + rate) / (w + 1) for w, s, _ in blocks] or [rate])
        self.value = np.maximum.accumulate(self.value)
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)
