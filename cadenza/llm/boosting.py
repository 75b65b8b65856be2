"""Small gradient-boosted trees: logistic loss, histogram splits, complete trees of fixed depth, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes); right where value > cut
    leaf: np.ndarray  # (trees, leaves)
    start: float
    slope: float = 1.0  # Platt calibration of the raw sum
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (leaf.shape[0] - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16, ridge: float = 1.0) -> Boosted:
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    raw, inner = np.full(len(x), start), 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        f, c, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for n in range(inner):
            mine, best = node == n, 1e-9
            gs, hs = g[mine].sum(), h[mine].sum()
            for j in range(x.shape[1]):
                left_g = np.cumsum(np.bincount(binned[mine, j], g[mine], bins + 1))
                left_h = np.cumsum(np.bincount(binned[mine, j], h[mine], bins + 1))
                gain = left_g**2 / (left_h + ridge) + (gs - left_g) ** 2 / (hs - left_h + ridge) - gs**2 / (hs + ridge)
                k = int(gain[: len(cuts[j])].argmax()) if len(cuts[j]) else 0
                if len(cuts[j]) and gain[k] > best:
                    best, f[n], c[n] = gain[k], j, cuts[j][k]
            node[mine] = 2 * n + 1 + (x[mine, f[n]] > c[n])
        at = node - inner
        value = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        raw = raw + value[at]
        features.append(f), thresholds.append(c), leaves.append(value)
    return Boosted(np.array(features), np.array(thresholds), np.array(leaves), start)


def calibrated(model: Boosted, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Boosted:
    """Platt scaling on rows that the trees were not fitted to."""
    raw, a, b = model.raw(x), 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        a, b = a - 0.05 * ((p - y) * raw).mean(), b - 0.05 * (p - y).mean()
    return Boosted(model.feature, model.cut, model.leaf, model.start, a, b)
