"""A small random forest and decision tree on numpy arrays, trained on the driver and broadcast."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Parallel arrays: a node with feature -1 is a leaf that answers ``value``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            feature = self.feature[at]
            open_ = feature >= 0
            if not open_.any():
                return self.value[at]
            rows = np.nonzero(open_)[0]
            go_left = x[rows, feature[rows]] <= self.threshold[at[rows]]
            at[rows] = np.where(go_left, self.left[at[rows]], self.right[at[rows]])


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float]:
    best, n = (1e-9, -1, 0.0), len(y)
    base = y.mean() * (1 - y.mean())
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, n)
        allowed = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if not allowed.any():
            continue
        left, right = ones[:-1] / k, (ones[-1] - ones[:-1]) / (n - k)
        gain = base - (k * left * (1 - left) + (n - k) * right * (1 - right)) / n
        i = int(np.argmax(np.where(allowed, gain, -1)))
        if gain[i] > best[0]:
            best = (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2))
    return best


def grow_tree(x: np.ndarray, y: np.ndarray, *, depth: int = 8, least: int = 2, tries: int | None = None, rng: np.random.Generator | None = None) -> Tree:
    """A classification tree by Gini gain; ``tries`` random features a split, all if None."""
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if level < depth and 0 < y[rows].sum() < len(rows):
            all_features = np.arange(x.shape[1])
            features = all_features if tries is None else np.sort(rng.choice(all_features, tries, replace=False))
            _, f, t = _best_split(x[rows], y[rows], features, least)
            if f >= 0:
                below = x[rows, f] <= t
                nodes[me][:4] = [f, t, add(rows[below], level + 1), add(rows[~below], level + 1)]
        return me

    add(np.arange(len(y)), 0)
    a = np.array(nodes, dtype=np.float64)
    return Tree(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4])


def grow_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 25, depth: int = 9, seed: int = 11) -> list[Tree]:
    rng = np.random.default_rng(seed)
    tries = max(2, int(np.ceil(np.sqrt(x.shape[1]))))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow_tree(x[rows], y[rows], depth=depth, tries=tries, rng=rng))
    return out


def forest_predict(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    """Mean answer of the trees, between 0 and 1."""
    return np.mean([t.predict(x) for t in forest], axis=0) if len(x) else np.zeros(0)
