"""Gradient-boosted trees on binned features and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees of one depth, stored as complete binary trees; margins are log-odds."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least_hessian: float = 2.0, l2: float = 1.0) -> Boosted:
    """Logistic boosting with histograms of gradients, level by level."""
    n, k = x.shape
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if n == 0 or y.min() == y.max():
        return Boosted(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    width = max(len(e) for e in edges) + 1
    margin = np.full(n, base)
    features, thresholds, leaf_values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            at = node - first
            best = np.zeros(many)
            for j in range(k):
                if not len(edges[j]):
                    continue
                key = at * width + codes[j]
                g = np.bincount(key, grad, many * width).reshape(many, width).cumsum(1)
                h = np.bincount(key, hess, many * width).reshape(many, width).cumsum(1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + l2) + (total_g - g) ** 2 / (total_h - h + l2) - total_g**2 / (total_h + l2)
                gain[(h < least_hessian) | (total_h - h < least_hessian)] = 0
                gain = gain[:, : len(edges[j])]
                cut = gain.argmax(1)
                value = gain[np.arange(many), cut]
                better = value > best + 1e-9
                best[better] = value[better]
                feature[first : first + many][better] = j
                threshold[first : first + many][better] = edges[j][cut[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        values = -rate * g / (h + l2)
        margin += values[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaf_values.append(values)
    return Boosted(base, np.array(features), np.array(thresholds), np.array(leaf_values))


@dataclass
class Isotonic:
    """A nondecreasing piecewise linear map, clamped outside its knots."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return np.interp(values, self.x, self.y)


def fit_isotonic(x: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; equal inputs are pooled first. Each pool gives a knot at both ends."""
    if not len(x):
        return Isotonic(np.array([0.0]), np.array([0.5]))
    order = np.argsort(x, kind="stable")
    values, begin = np.unique(x[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), begin)
    sizes = np.diff(np.append(begin, len(x)))
    pools: list[list[float]] = []
    for v, s, n in zip(values, sums, sizes, strict=True):
        pools.append([s, n, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, n2, _, high = pools.pop()
            pools[-1][0] += s2
            pools[-1][1] += n2
            pools[-1][3] = high
    knots_x, knots_y = [], []
    for s, n, low, high in pools:
        # one pseudo-row of the pool's complement keeps probabilities off 0 and 1
        level = (s + 0.5) / (n + 1)
        for v in (low, high) if high > low else (low,):
            knots_x.append(v)
            knots_y.append(level)
    return Isotonic(np.array(knots_x), np.maximum.accumulate(np.array(knots_y)))
