"""Gradient-boosted regression trees for a yes/no target, in numpy, on features of few levels."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees; a row goes right where its feature is above the threshold."""

    depth: int
    start: float
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def leaf(self, x: np.ndarray, features: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, features[at]] > thresholds[at])
        return at - (2**self.depth - 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Logarithm of the odds of yes."""
        out = np.full(len(x), self.start)
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves):
            out += leaves[self.leaf(x, features, thresholds)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 2.0) -> Trees:
    """``x``: whole numbers from 0 to 31.  Second-order logistic boosting over histograms."""
    n, width = x.shape
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    trees = Trees(depth, float(np.log(share / (1 - share))))
    if not n or y.min() == y.max():
        return trees
    levels = int(x.max()) + 1
    flat = (x.astype(np.int64) + np.arange(width) * levels).ravel()
    score = np.full(n, trees.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        features = np.zeros(2**depth - 1, np.int64)
        thresholds = np.full(2**depth - 1, levels, np.int64)  # no row is above
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = (np.repeat(at - first, width) * width * levels) + flat
            size = count * width * levels
            gs = np.bincount(cell, np.repeat(g, width), size).reshape(count, width, levels)
            hs = np.bincount(cell, np.repeat(h, width), size).reshape(count, width, levels)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
            best = gain.reshape(count, -1).argmax(1)
            useful = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            features[first : first + count] = np.where(useful, best // levels, 0)
            thresholds[first : first + count] = np.where(useful, best % levels, levels)
            at = 2 * at + 1 + (x[np.arange(n), features[at]] > thresholds[at])
        leaf = at - (2**depth - 1)
        gsum, hsum = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        leaves = -rate * gsum / (hsum + ridge)
        score += leaves[leaf]
        trees.features.append(features)
        trees.thresholds.append(thresholds)
        trees.leaves.append(leaves)
    return trees
