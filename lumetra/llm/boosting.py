"""Gradient-boosted trees for a yes/no label: histogram splits in numpy, bounded training sets only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Trees:
    """Complete trees of one depth: feature and threshold by inner node, value by leaf."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth, self.trees = base, depth, []

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out

    def column(self, features: list[Column]) -> Column:
        """The same score as a JVM expression: one nested CASE a tree."""

        def node(tree, i: int) -> Column:
            feature, cut, leaf = tree
            if i >= len(feature):
                return F.lit(float(leaf[i - len(feature)]))
            low, high = node(tree, 2 * i + 1), node(tree, 2 * i + 2)
            return low if np.isinf(cut[i]) else F.when(features[feature[i]] > float(cut[i]), high).otherwise(low)

        total = F.lit(float(self.base))
        for tree in self.trees:
            total = total + node(tree, 0)
        return total


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0, least: int = 4) -> Trees:
    """Newton boosting of the logistic loss; every step is deterministic."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(mean / (1 - mean))), depth)
    score = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            split = np.full(n, False)
            choice = {}
            local = at - first
            total_g, total_h = np.bincount(local, g, count), np.bincount(local, h, count)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                size = len(cuts[f]) + 1
                slot = local * size + binned[:, f]
                left_g = np.bincount(slot, g, count * size).reshape(count, size).cumsum(1)[:, :-1]
                left_h = np.bincount(slot, h, count * size).reshape(count, size).cumsum(1)[:, :-1]
                left_n = np.bincount(slot, minlength=count * size).reshape(count, size).cumsum(1)
                right_n, left_n = left_n[:, -1:] - left_n[:, :-1], left_n[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - (total_g**2 / (total_h + l2))[:, None]
                gain[(left_n < least) | (right_n < least)] = -1
                top = gain.argmax(1)
                for k in np.nonzero(gain[np.arange(count), top] > best)[0]:
                    best[k] = gain[k, top[k]]
                    choice[k] = (f, top[k])
            for k, (f, b) in choice.items():
                feature[first + k], cut[first + k] = f, cuts[f][b]
                split |= (local == k) & (binned[:, f] > b)
            at = 2 * at + 1 + split
        leaf_of = at - inner
        leaf = rate * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + l2)
        model.trees.append((feature, cut, leaf))
        score += leaf[leaf_of]
    return model
