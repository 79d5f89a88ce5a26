"""Histogram gradient-boosted trees for binary labels, in numpy.

Values are binned once by quantiles. Trees are complete binary trees of one depth
in heap order, grown level by level from per-bin sums of gradients. A model is a
few arrays, so scoring walks all rows through a tree with one gather per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """feature, threshold: (trees, 2**depth - 1); leaf: (trees, 2**depth)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    @property
    def depth(self) -> int:
        return int(self.leaf.shape[1]).bit_length() - 1

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        row = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    ranks = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], ranks)) for j in range(x.shape[1])]


def fit(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    penalty: float = 1.0,
    least_weight: float = 3.0,
    weight: np.ndarray | None = None,
) -> Trees:
    """Fit logistic loss. No rows, or one class alone, give a constant score:
    the smoothed share of label 1 (0.5 for no rows)."""
    y = np.asarray(y, dtype=np.float64)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=np.float64)
    positives = float(y.sum())
    share = (float((w * y).sum()) + 0.5) / (float(w.sum()) + 1.0)
    bias = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or positives in (0.0, float(len(y))):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), bias)
    edges = _bin_edges(x, bins)
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = bins
    margin = np.full(len(y), bias)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        feature = np.zeros(inner, np.int64)
        threshold = np.full(inner, np.inf)
        cut = np.full(inner, width, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.full(count, 1e-9)
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                slot = at * width + binned[:, j]
                gs = np.bincount(slot, g, count * width).reshape(count, width)
                hs = np.bincount(slot, h, count * width).reshape(count, width)
                left_g, left_h = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                all_g, all_h = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = (
                    left_g**2 / (left_h + penalty)
                    + right_g**2 / (right_h + penalty)
                    - all_g**2 / (all_h + penalty)
                )
                gain[(left_h < least_weight) | (right_h < least_weight)] = 0
                gain[:, len(edges[j]) :] = 0
                where = gain.argmax(1)
                value = gain[np.arange(count), where]
                for k in np.flatnonzero(value > best):
                    best[k], feature[first + k], cut[first + k] = value[k], j, where[k]
                    threshold[first + k] = edges[j][where[k]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        leaf = -rate * gs / (hs + penalty)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(values), bias)
