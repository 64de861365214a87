"""Gradient-boosted trees for a binary outcome (logistic loss, Newton leaves), in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: by level, feature and threshold of each node; value of each leaf."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, cuts: int = 16, ridge: float = 1.0) -> Trees:
        """Splits are sought at up to ``cuts`` quantiles of each feature."""
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        model = cls(float(np.log(p / (1 - p))))
        f = np.full(len(y), model.base)
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, cuts + 1)[1:-1])) for k in range(x.shape[1])]
        below = [(k, e, x[:, k] <= e) for k, es in enumerate(edges) for e in es]
        sides = np.array([b for _, _, b in below], dtype=np.float64)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), np.int64)
            features, thresholds = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                for n in range(2**level):
                    at = 2**level - 1 + n
                    inside = node == n
                    gi, hi = g * inside, h * inside
                    left_g, left_h = sides @ gi, sides @ hi
                    gain = left_g**2 / (left_h + ridge) + (gi.sum() - left_g) ** 2 / (hi.sum() - left_h + ridge) - gi.sum() ** 2 / (hi.sum() + ridge)
                    best = int(np.argmax(gain))
                    if gain[best] > 1e-9:
                        features[at], thresholds[at] = below[best][0], below[best][1]
                node = 2 * node + (x[np.arange(len(y)), features[2**level - 1 + node]] > thresholds[2**level - 1 + node])
            values = rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge)
            model.trees.append((features, thresholds, values))
            f += values[node]
        return model

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for features, thresholds, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(int(np.log2(len(values)))):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, features[at]] > thresholds[at])
            f += values[node]
        return 1 / (1 + np.exp(-f))
