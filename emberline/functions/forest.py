"""Isolation forests in flat arrays: fitted on a bounded sample, applied to any number of rows."""

from __future__ import annotations

import math

import numpy as np


class Forest:
    """All trees of all rows go down at once."""

    def __init__(self, x: np.ndarray, trees: int = 50, drawn: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.drawn = min(drawn, len(x))
        self.depth = max(1, math.ceil(math.log2(max(2, self.drawn))))
        self.feature, self.split, self.left, self.length, self.roots = [], [], [], [], []
        for _ in range(trees if len(x) else 0):
            self.roots.append(self._grow(x[rng.choice(len(x), self.drawn, replace=False)], rng))
        self.feature, self.split, self.left, self.length, self.roots = map(np.array, (self.feature, self.split, self.left, self.length, self.roots))

    @staticmethod
    def mean_path(n: int) -> float:
        """Mean path of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _node(self) -> int:
        for a in (self.feature, self.split, self.left, self.length):
            a.append(0)
        return len(self.left) - 1

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> int:
        root = self._node()
        stack = [(root, x, 0)]
        while stack:
            at, rows, depth = stack.pop()
            wide = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if depth < self.depth else ()
            if not len(wide):
                self.left[at], self.length[at], self.split[at] = at, depth + self.mean_path(len(rows)), math.inf  # a leaf leads to itself
                continue
            f = int(rng.choice(wide))
            s = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            below = rows[:, f] <= s
            self.feature[at], self.split[at], self.left[at] = f, s, self._node()
            self._node()
            stack += [(self.left[at], rows[below], depth + 1), (self.left[at] + 1, rows[~below], depth + 1)]
        return root

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1); 0.5 if the forest is empty."""
        if not len(self.roots):
            return np.full(len(x), 0.5)
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = self.left[at] + (x[rows, self.feature[at]] > self.split[at])
        return 2.0 ** (-self.length[at].mean(axis=1) / max(self.mean_path(self.drawn), 1e-9))
