"""Gradient-boosted trees for small tables of features: logistic loss, histogram splits, numpy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes as arrays: feature (-1 at a leaf), threshold, left child (the right one follows it), value."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.left.append(-1)
        self.value.append(0.0)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, value = map(np.array, (self.feature, self.threshold, self.left, self.value))
        at = np.zeros(len(x), int)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return value[at]
            rows = np.nonzero(inner)[0]
            node = at[rows]
            at[rows] = left[node] + (x[rows, feature[node]] > threshold[node])


class BoostedTrees:
    """Binary classifier; probabilities from the summed leaf values."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, least_rows: int = 4, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least_rows, self.ridge = rounds, depth, rate, least_rows, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        edges = []
        for column in x.T:
            values = np.unique(column)
            if len(values) > 32:
                values = np.unique(np.quantile(column, np.linspace(0, 1, 33)))
            edges.append((values[:-1] + values[1:]) / 2)
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, edges, q - y, np.maximum(q * (1 - q), 1e-6))
            self.trees.append(tree)
            score += tree.predict(x)
        return self

    def _grow(self, binned: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray) -> Tree:
        tree = Tree()
        todo = [(tree.add(), np.arange(len(g)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            tree.value[node] = -self.rate * gs / (hs + self.ridge)
            if depth == self.depth or len(rows) < 2 * self.least_rows:
                continue
            best = (1e-6, -1, 0)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(n < self.least_rows) | (len(rows) - n < self.least_rows)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] < 0:
                continue
            _, f, k = best
            low = binned[rows, f] <= k
            left = tree.add()
            right = tree.add()
            tree.feature[node], tree.threshold[node], tree.left[node] = f, float(edges[f][k]), left
            todo += [(left, rows[low], depth + 1), (right, rows[~low], depth + 1)]
        return tree

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        return 1 / (1 + np.exp(-(self.base + sum(t.predict(x) for t in self.trees))))
