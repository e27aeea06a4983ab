"""Gradient-boosted trees for a binary label and isotonic calibration, over numpy arrays of bounded size."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    start: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Newton steps on the logistic loss; splits are searched over quantile bins of each feature."""
    p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    trees = Trees(float(np.log(p / (1 - p))), depth)
    if not len(y) or y.min() == y.max():
        return trees
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    raw, inner = np.full(len(y), trees.start), 2**depth - 1
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-raw))
        g, h = y - q, q * (1 - q)
        feature, threshold, at = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(len(y), dtype=np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            best = 1e-6
            for j, c in enumerate(cuts):
                if not len(c) or not len(rows):
                    continue
                left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                gain[(left_h < least) | (total_h - left_h < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, feature[node], threshold[node] = gain[k], j, c[k]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        raw += value[leaf]
        trees.feature.append(feature)
        trees.threshold.append(threshold)
        trees.value.append(value)
    return trees


@dataclass
class Isotonic:
    """A non-decreasing function through (x, y), linear between points and constant beyond them."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


def isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pools adjacent violators over the rows in order of their raw score; a pool stands at its mean raw score. Each
    pool's share is drawn half a row towards one half, so that no score is quite 0 or 1."""
    if not len(raw):
        return Isotonic(np.array([-20.0, 20.0]), np.array([0.0, 1.0]))
    keys, inverse = np.unique(raw, return_inverse=True)
    n, ones = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    pools: list[list[float]] = []
    for k, w, s in zip(keys, n, ones, strict=True):
        pools.append([k * w, w, s])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return Isotonic(np.array([a / w for a, w, _ in pools]), np.array([(s + 0.25) / (w + 0.5) for _, w, s in pools]))
