"""A small gradient-boosted tree learner on binned features (logistic loss, numpy)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boost:
    trees: int = 40
    depth: int = 4
    rate: float = 0.25
    bins: int = 32
    ridge: float = 1.0
    least: float = 4.0


@dataclass(frozen=True)
class Forest:
    """Complete trees: a node's children are 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += value[at - (len(feature))]
        return out


def fit_forest(x: np.ndarray, y: np.ndarray, boost: Boost = Boost()) -> Forest:
    """Boosted trees for a 0/1 target; splits maximise the second-order gain."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, boost.bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner, leaves = 2**boost.depth - 1, 2**boost.depth
    features, limits, values = [], [], []
    for _ in range(boost.trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(boost.depth):
            first, many = 2**level - 1, 2**level
            slot = at - first
            best = np.full(many, 1e-6)
            g_all = np.bincount(slot, gradient, many)
            h_all = np.bincount(slot, curvature, many)
            parent = g_all**2 / (h_all + boost.ridge)
            for j in range(width):
                k = len(edges[j]) + 1
                if k < 2:
                    continue
                cell = slot * k + binned[:, j]
                g = np.bincount(cell, gradient, many * k).reshape(many, k).cumsum(axis=1)[:, :-1]
                h = np.bincount(cell, curvature, many * k).reshape(many, k).cumsum(axis=1)[:, :-1]
                gr, hr = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + boost.ridge) + gr**2 / (hr + boost.ridge) - parent[:, None]
                gain[(h < boost.least / 4) | (hr < boost.least / 4)] = 0
                cut = gain.argmax(axis=1)
                top = gain[np.arange(many), cut]
                for node in np.flatnonzero(top > best):
                    best[node] = top[node]
                    feature[first + node], limit[first + node] = j, edges[j][cut[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > limit[at])
        leaf = at - inner
        value = (
            boost.rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, curvature, leaves) + boost.ridge)
        )
        margin += value[leaf]
        features.append(feature), limits.append(limit), values.append(value)
    return Forest(base, np.array(features), np.array(limits), np.array(values))
