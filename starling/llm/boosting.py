"""Small gradient-boosted trees and isotonic calibration in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Log-loss boosting over binned features; every tree is complete, of ``depth`` levels."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 48
    smoothing: float = 1.0
    base: float = 0.0
    forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        share = min(max(float((y * weight).sum() / weight.sum()), 1e-6), 1 - 1e-6)
        self.base, self.forest = float(np.log(share / (1 - share))), []
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(codes, cuts, (y - p) * weight, np.maximum(p * (1 - p), 1e-9) * weight)
            self.forest.append(tree)
            score += self._tree_scores(x, tree)
        return self

    def _grow(self, codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple:
        nodes = 2**self.depth - 1
        feature, limit, node = np.zeros(nodes, int), np.full(nodes, np.inf), np.zeros(len(codes), int)
        width = self.bins + 1
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                cell = (node - first) * width + codes[:, f]
                g = np.bincount(cell, gradient, n * width).reshape(n, width).cumsum(axis=1)
                h = np.bincount(cell, hessian, n * width).reshape(n, width).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + self.smoothing) + (all_g - g) ** 2 / (all_h - h + self.smoothing) - all_g**2 / (all_h + self.smoothing)
                gain = gain[:, : len(edges)]
                at = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(n), at] > best):
                    best[i], feature[first + i], limit[first + i] = gain[i, at[i]], f, edges[at[i]]
            values = np.take_along_axis(codes, feature[node][:, None], axis=1)[:, 0]
            bounds = np.array([np.searchsorted(cuts[f], t) if np.isfinite(t) else width for f, t in zip(feature, limit)])
            node = 2 * node + 1 + (values > bounds[node])
        leaf = node - nodes
        g, h = np.bincount(leaf, gradient, nodes + 1), np.bincount(leaf, hessian, nodes + 1)
        return feature, limit, self.rate * g / (h + self.smoothing)

    def _tree_scores(self, x: np.ndarray, tree: tuple) -> np.ndarray:
        feature, limit, leaves = tree
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
        return leaves[node - len(feature)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        total = np.full(len(x), self.base)
        for tree in self.forest:
            total += self._tree_scores(x, tree)
        return total


@dataclass
class Isotonic:
    """Weighted monotone fit by pooling neighbours; between fitted scores it is linear."""

    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    value: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
        points, group = np.unique(score, return_inverse=True)
        mass = np.bincount(group, weight)
        mean = np.bincount(group, weight * y) / mass
        blocks: list[list[float]] = []
        for m, w, p in zip(mean, mass, points):
            blocks.append([m, w, p, p])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m2, w2, _, high = blocks.pop()
                m1, w1, low, _ = blocks[-1]
                blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, low, high]
        self.at = np.array([p for b in blocks for p in b[2:]])
        self.value = np.array([b[0] for b in blocks for _ in (0, 1)])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.at, self.value), 0.0, 1.0)
