"""Exact regression and classification trees over a bounded sample, and their lookup as Spark expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trees of so many leaves become nested CASE expressions; larger ones are looked up in Arrow batches.
CASE_LEAVES = 512


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. Rows of `feature` <= threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.feature < 0)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            f = self.feature[at[rows]]
            at[rows] = np.where(x[rows, f] <= self.threshold[at[rows]], self.left[at[rows]], self.right[at[rows]])
        return at

    def column(self, features: Sequence[Column], value: Mapping[int, Column]) -> Column:
        """A Column that gives value[leaf] for a row's features."""

        def node(i: int) -> Column:
            if self.feature[i] < 0:
                return value[i]
            return F.when(features[self.feature[i]] <= F.lit(float(self.threshold[i])), node(int(self.left[i]))).otherwise(node(int(self.right[i])))

        return node(0)


def _ranked(seed: int | str, target: str, names: Sequence[str]) -> list[int]:
    """The features in an order that only seed, target and names decide; of equally good splits the first feature's wins."""
    return sorted(range(len(names)), key=lambda i: hashlib.sha256(f"{seed}\0cart\0{target}\0{names[i]}".encode()).hexdigest())


def fit(x: np.ndarray, y: np.ndarray, classes: int | None, names: Sequence[str], *, max_depth: int | None = None, min_leaf: int = 5, seed: int | str = 0, target: str = "", weights: np.ndarray | None = None) -> Tree:
    """Split by least squared error, or by least Gini impurity where y holds `classes` codes, at midpoints.

    Both sides keep min_leaf rows. Equal gains go to the first feature of a seeded order, then the lowest threshold.
    weights: of how many equal rows each one stands.
    """
    w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
    order = _ranked(seed, target, names)
    feature, threshold, left, right = [-1], [0.0], [-1], [-1]
    stack = [(0, np.arange(len(x)), 0)]
    while stack:
        i, rows, depth = stack.pop()
        if w[rows].sum() < 2 * min_leaf or (max_depth is not None and depth >= max_depth):
            continue
        best = None
        for f in order:
            found = _split(x[rows, f], y[rows], w[rows], classes, min_leaf)
            if found and (best is None or found[0] > best[0] + 1e-12 * max(1.0, abs(best[0]))):
                best = (*found, f)
        if best is None:
            continue
        _, cut, f = best
        goes_left = x[rows, f] <= cut
        feature[i], threshold[i], left[i], right[i] = f, cut, len(feature), len(feature) + 1
        for part in (rows[goes_left], rows[~goes_left]):
            stack.append((len(feature), part, depth + 1))
            feature.append(-1), threshold.append(0.0), left.append(-1), right.append(-1)
    return Tree(*(np.array(a) for a in (feature, threshold, left, right)))


def _split(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int | None, min_leaf: int) -> tuple[float, float] | None:
    """Gain and threshold of the best split of one feature; w tells how many rows each one stands for."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    upto = np.cumsum(w)
    n = upto[-1]
    cuts = np.flatnonzero(x[:-1] < x[1:]) + 1
    cuts = cuts[(upto[cuts - 1] >= min_leaf) & (n - upto[cuts - 1] >= min_leaf)]
    if not len(cuts):
        return None
    left = upto[cuts - 1]
    if classes is None:
        z = y - (w * y).sum() / n  # centred, so that sums of squares keep their digits
        sums = np.cumsum(w * z)
        a, total = sums[cuts - 1], sums[-1]
        gain = a * a / left + (total - a) ** 2 / (n - left) - total * total / n
        floor = 1e-12 * float((w * z * z).sum())
    else:
        used, codes = np.unique(y, return_inverse=True)
        if len(used) < 2:
            return None
        gain = np.zeros(len(cuts))
        base = 0.0
        for c in range(len(used)):
            of = np.cumsum(w * (codes == c))
            a, total = of[cuts - 1], float(of[-1])
            gain += a * a / left + (total - a) ** 2 / (n - left)
            base += total * total / n
        gain -= base
        floor = 1e-12 * n
    k = int(np.argmax(gain))
    if gain[k] <= floor:
        return None
    low, high = float(x[cuts[k] - 1]), float(x[cuts[k]])
    middle = low + (high - low) / 2
    return float(gain[k]), middle if middle < high else low
