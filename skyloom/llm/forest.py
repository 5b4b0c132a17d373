"""Gradient-boosted trees for two classes: trained on a bounded sample, kept as flat numpy node arrays.

All trees share one set of arrays (feature, cut, left, right, value), so scoring is
a few vectorised steps down for all rows and trees at once. Features can be held
monotonic: a split whose children would go against the sign is not made, and below
a split the children's values stay on their sides of its middle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    base: float
    feature: np.ndarray  # -1: a leaf
    cut: np.ndarray  # left if x <= cut
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds for rows of features."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[node]
            goes_left = x[rows, np.maximum(feature, 0)] <= self.cut[node]
            node = np.where(feature < 0, node, np.where(goes_left, self.left[node], self.right[node]))
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def train(
    x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 5.0
) -> Forest:
    """Fit to 0/1 labels. ``signs``: for each feature 1 or -1 if the odds may only rise or fall with it, else 0."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if len(x) else np.zeros(x.shape, int)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def leaf_value(g, h, low, high):
        return float(np.clip(-g / (h + ridge), low, high))

    def grow(rows, g, h, level, low, high):
        me = len(feature)
        feature.append(-1), cut.append(0.0), left.append(me), right.append(me)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value.append(rate * leaf_value(total_g, total_h, low, high))
        best = (1e-6, None)
        for f in range(x.shape[1]) if level < depth and len(rows) > 1 else ():
            n = len(cuts[f]) + 1
            gs = np.cumsum(np.bincount(binned[rows, f], g[rows], n))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, f], h[rows], n))[:-1]
            if not len(gs):
                continue
            a = np.clip(-gs / (hs + ridge), low, high)
            b = np.clip(-(total_g - gs) / (total_h - hs + ridge), low, high)
            gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
            ok = (np.minimum(hs, total_h - hs) * 4 >= least) & ((b - a) * signs[f] >= 0)
            at = int(np.argmax(np.where(ok, gain, -1)))
            if ok[at] and gain[at] > best[0]:
                best = (gain[at], (f, at, a[at], b[at]))
        if best[1] is not None:
            f, at, a, b = best[1]
            middle = (a + b) / 2
            low_left, high_left, low_right, high_right = low, high, low, high
            if signs[f] > 0:
                high_left, low_right = middle, middle
            elif signs[f] < 0:
                low_left, high_right = middle, middle
            feature[me], cut[me] = f, float(cuts[f][at])
            goes_left = binned[rows, f] <= at
            left[me] = grow(rows[goes_left], g, h, level + 1, low_left, high_left)
            right[me] = grow(rows[~goes_left], g, h, level + 1, low_right, high_right)
        return me

    for _ in range(trees if len(y) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        start = len(feature)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        one = Forest(0.0, *_arrays(feature, cut, left, right, value, start), np.array([0]), depth)
        margin += one.margin(x)
    return Forest(base, *_arrays(feature, cut, left, right, value, 0), np.array(roots, np.int64), depth)


def _arrays(feature, cut, left, right, value, start):
    whole = np.array(left[start:], np.int64) - start, np.array(right[start:], np.int64) - start
    return np.array(feature[start:], np.int64), np.array(cut[start:], float), *whole, np.array(value[start:], float)
