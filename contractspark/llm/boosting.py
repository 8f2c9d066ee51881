"""Gradient-boosted trees over binned features: logistic loss, trees of fixed depth.

All that the trees learn from are sums of the rows' gradients by node, feature and bin (:func:`level_sums`), whatever the
number of rows; tables of any size are fitted by adding up the sums of their parts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

BINS = 32
#: Gradients are added up as whole numbers of this unit, so that the order of the parts changes nothing.
UNITS = 1 << 20


@dataclass
class Trees:
    """``score`` adds up the trees' leaves; ``probability`` is its logistic function."""

    depth: int = 3
    rate: float = 0.3
    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    limit: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def node_of(self, x: np.ndarray, k: int, level: int) -> np.ndarray:
        """Place of each row's node among those of a level of tree ``k``."""
        node = np.zeros(len(x), np.int64)
        for _ in range(level):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[k][node]] > self.limit[k][node])
        return node - (2**level - 1)

    def added(self, x: np.ndarray, k: int) -> np.ndarray:
        """What tree ``k`` adds to each row's score."""
        return self.leaf[k][self.node_of(x, k, self.depth)]

    def over(self, cuts: list[np.ndarray]) -> Trees:
        """Trees over values, from trees over bins that end at these cuts."""
        value = lambda j, k: cuts[j][int(k)] if np.isfinite(k) else np.inf
        limit = [np.array([value(*split) for split in zip(f, at)]) for f, at in zip(self.feature, self.limit)]
        return replace(self, limit=limit)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for k in range(len(self.leaf)):
            total += self.added(x, k)
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.score(x)))


Sums = Callable[[Trees, int], np.ndarray]


def level_sums(trees: Trees, level: int, x: np.ndarray, y: np.ndarray, n: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Slopes and curves (in ``UNITS``) of rows that occur ``n`` times, by node of the last tree's level, feature and bin.

    ``x`` holds bins and the trees' limits are bins too; ``score`` is that of the trees before the last.
    """
    p = 1 / (1 + np.exp(-score))
    gradients = np.rint((y - p) * UNITS) * n, np.rint(p * (1 - p) * UNITS) * n
    node = trees.node_of(x, -1, level) * BINS
    found = np.zeros((2**level, x.shape[1], BINS, 2), np.int64)
    for j in range(x.shape[1]):
        for k, values in enumerate(gradients):
            found[:, j, :, k] = np.bincount(node + x[:, j], values, 2**level * BINS).reshape(-1, BINS)
    return found


def sums_of(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> Sums:
    """The sums over rows at hand; their score grows tree by tree."""
    score, done = np.zeros(len(x)), 0

    def sums(trees: Trees, level: int) -> np.ndarray:
        nonlocal score, done
        while done < len(trees.leaf) - 1:
            score, done = score + trees.added(x, done), done + 1
        return level_sums(trees, level, x, y, n, trees.start + score)

    return sums


def grow(sums: Sums, cuts: list[np.ndarray], positive: int, rows: int, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Trees over bins (:meth:`Trees.over` gives those over values). Newton steps: each node takes the split with the largest gain over the bins of all features.

    A feature's bin is the number of its cuts that are smaller; ``rows`` rows, ``positive`` of them positive, are
    known by their sums alone.
    """
    share = (positive + 1) / (rows + 2)
    trees = Trees(depth, rate, float(np.log(share / (1 - share))))
    splits = np.arange(BINS) < np.array([[len(c)] for c in cuts])
    for _ in range(rounds if rows else 0):
        trees.feature.append(np.zeros(2**depth - 1, np.int64))
        trees.limit.append(np.full(2**depth - 1, np.inf))
        trees.leaf.append(np.zeros(2**depth))
        for level in range(depth):
            left = sums(trees, level).cumsum(axis=2) / UNITS
            whole = left[:, :, -1:]
            (g, h), (other_g, other_h), (all_g, all_h) = (np.moveaxis(a, -1, 0) for a in (left, whole - left, whole))
            gain = np.where(splits, g**2 / (h + ridge) + other_g**2 / (other_h + ridge) - all_g**2 / (all_h + ridge), 0)
            for at in range(2**level):
                j, k = np.unravel_index(gain[at].argmax(), splits.shape)
                if gain[at, j, k] <= 1e-9:
                    k = BINS - 1  # all rows go left
                else:
                    trees.feature[-1][2**level - 1 + at], trees.limit[-1][2**level - 1 + at] = j, k
                if level == depth - 1:
                    for side, (g_sum, h_sum) in enumerate((left[at, j, k], whole[at, j, 0] - left[at, j, k])):
                        trees.leaf[-1][2 * at + side] = rate * g_sum / (h_sum + ridge)
    return trees


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Trees over a table at hand, its features cut at their quantiles."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    return grow(sums_of(binned(x, cuts), y, np.ones(len(x))), cuts, int(y.sum()), len(x), rounds, depth, rate, ridge).over(cuts)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value."""
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)


def calibrated(scores: np.ndarray, y: np.ndarray, precision: float, least: float, n: np.ndarray | None = None) -> float:
    """The smallest threshold, ``least`` at least, from which held-out scores up have the wanted precision.

    ``n`` says how often each row occurs, once if not given.
    """
    order = np.argsort(-scores, kind="stable")
    n = (np.ones(len(y)) if n is None else n)[order]
    right = np.cumsum(y[order] * n) / np.cumsum(n)
    ends = np.flatnonzero(np.append(scores[order][1:] != scores[order][:-1], True)) if len(order) else np.zeros(0, np.int64)
    good = ends[right[ends] >= precision]
    return max(least, float(scores[order[good[-1]]])) if len(good) else 1.0
