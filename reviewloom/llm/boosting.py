"""Gradient-boosted trees for a yes or no, on binned features; small enough to ship as arrays."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Trees of a fixed depth as arrays: feature and threshold per inner place, value per leaf."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.features: list[np.ndarray] = []
        self.thresholds: list[np.ndarray] = []
        self.values: list[np.ndarray] = []

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.features, self.thresholds, self.values):
            place = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                place = 2 * place + 1 + (x[rows, feature[place]] > threshold[place])
            out += value[place - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Boosting with second-order gains of the logistic loss over quantile bins."""
    n, width = x.shape
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), depth)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    score = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = p - y, p * (1 - p)
        feature = np.zeros(inner, dtype=np.int64)
        threshold = np.full(inner, np.inf)
        place = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = place - first
            best = np.zeros(count)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                key = at * BINS + binned[:, f]
                g = np.bincount(key, slope, count * BINS).reshape(count, BINS).cumsum(1)
                h = np.bincount(key, bend, count * BINS).reshape(count, BINS).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain = gain[:, : len(cuts[f])]
                cut = gain.argmax(1)
                top = gain[np.arange(count), cut]
                better = top > best + 1e-9
                best = np.where(better, top, best)
                feature[first : first + count][better] = f
                threshold[first : first + count][better] = cuts[f][cut[better]]
            place = 2 * place + 1 + (x[np.arange(n), feature[place]] > threshold[place])
        leaf = place - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, bend, inner + 1)
        value = -rate * g / (h + ridge)
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.values.append(value)
        score += value[leaf]
    return model
