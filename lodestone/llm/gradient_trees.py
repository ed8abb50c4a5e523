"""Gradient-boosted trees on histograms, flattened into arrays, for a bounded sample of rows.

Features are cut into bins at quantiles of the sample. A tree grows level by level: for each open node and feature one
``bincount`` adds up gradients and curvatures by bin, sums of those from the left give every cut's gain, and the best cut
splits the node. The logistic loss, Newton steps as leaves, ridge penalty ``l2``, and rows may weigh differently.

A tree is a complete binary tree in arrays, node k with children 2k + 1 and 2k + 2, so a whole batch goes down all trees with
one gather a level. A node that isn't split sends all rows left (its edge is infinite).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Growth:
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.12
    l2: float = 2.0
    least_curvature: float = 2.0  #: of a child
    least_gain: float = 1e-3


@dataclass
class Forest:
    """feature, edge: of each inner node of each tree; leaf: values of each tree's last level; start: the score before any tree."""

    feature: np.ndarray
    edge: np.ndarray
    leaf: np.ndarray
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The sum of leaf values of each row of x."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.start)
        if not trees:
            return total
        tree, node = np.arange(trees)[None, :], np.zeros((len(x), trees), np.int32)
        row = np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            right = x[row, self.feature[tree, node]] > self.edge[tree, node]
            node = 2 * node + 1 + right
        return total + self.leaf[tree, node - inner].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -35, 35)))


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each feature the ascending values between bins: bin k holds what is above edge k - 1 and not above edge k."""
    out = []
    for column in np.sort(x, axis=0).T:
        seen = np.unique(column)
        if len(seen) > bins:
            seen = np.unique(column[np.linspace(0, len(column) - 1, bins + 1).astype(int)])
        out.append((seen[1:] + seen[:-1]) / 2)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T, strict=True)], axis=1) if len(cuts) else np.zeros(x.shape, np.int64)


def _split(places: np.ndarray, rows: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, features: int, bins: int, how: Growth):
    """The best cut of each node: gain, feature and last bin on the left."""
    size = nodes * features * bins
    slot = (at[:, None] * (features * bins) + places[rows]).ravel()
    gs, hs = (np.bincount(slot, np.repeat(v[rows], features), size).reshape(nodes, features, bins) for v in (g, h))
    left_g, left_h = gs.cumsum(axis=2), hs.cumsum(axis=2)
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + how.l2) + right_g**2 / (right_h + how.l2) - all_g**2 / (all_h + how.l2)
    gain[(left_h < how.least_curvature) | (right_h < how.least_curvature)] = 0
    flat = gain.reshape(nodes, -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(nodes), best], best // bins, best % bins


def grown(x: np.ndarray, y: np.ndarray, weight: np.ndarray, how: Growth) -> Forest:
    """Trees for rows x, labels y (boolean) and weights."""
    inner, features = (1 << how.depth) - 1, x.shape[1]
    share = float(np.average(y, weights=weight)) if len(y) else 0.0
    start = float(np.log(share / (1 - share))) if 0 < share < 1 else (35.0 if share else -35.0)
    none = Forest(np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    if not 0 < share < 1:
        return none
    cuts = edges(x, how.bins)
    bins = max(len(c) for c in cuts) + 1
    places = binned(x, cuts) + np.arange(features) * bins
    made = {"feature": [], "edge": [], "leaf": []}
    margin = np.full(len(x), start)
    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, edge = np.zeros(inner, np.int32), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(how.depth):
            first = (1 << level) - 1
            number = np.full(1 << level, -1)
            # a node that isn't split sends its rows down the left edge, where they may meet a cut
            present = np.unique(node - first)
            number[present] = np.arange(len(present))
            at = number[node - first]
            gain, by, last = _split(places, np.arange(len(x)), at, g, h, len(present), features, bins, how)
            for k in np.flatnonzero(gain > how.least_gain):
                own = first + present[k]
                feature[own], edge[own] = by[k], cuts[by[k]][last[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > edge[node])
        at = node - inner
        leaf = -how.rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + how.l2)
        margin = margin + leaf[at]
        for name, value in (("feature", feature), ("edge", edge), ("leaf", leaf)):
            made[name].append(value)
    return Forest(np.array(made["feature"], np.int32), np.array(made["edge"]), np.array(made["leaf"]), start)
