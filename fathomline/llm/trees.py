"""Gradient-boosted trees with logistic loss, and isotonic calibration, in numpy. For bounded samples on one machine."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of equal depth over features cut into bins at quantiles."""

    def __init__(self, trees: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 48, least: float = 5.0, ridge: float = 1.0) -> None:
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)
        rate = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(n, self.start)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            leaf, tree = self._grow(codes, g, h)
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _grow(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Splits in the order of a heap: feature (-1: none) and threshold of each inner node, value of each leaf."""
        inner = 2**self.depth - 1
        feature, cut = np.full(inner, -1), np.zeros(inner)
        at = np.zeros(len(g), np.int64)
        gain_of = lambda gs, hs: gs * gs / (hs + self.ridge)
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            node = at - first
            choice = [(-1, 0)] * count
            for f, cuts in enumerate(self.cuts):
                k = len(cuts) + 1
                if k < 2:
                    continue
                slot = node * k + codes[:, f]
                gs = np.bincount(slot, g, count * k).reshape(count, k).cumsum(axis=1)
                hs = np.bincount(slot, h, count * k).reshape(count, k).cumsum(axis=1)
                left_g, left_h = gs[:, :-1], hs[:, :-1]
                right_g, right_h = gs[:, -1:] - left_g, hs[:, -1:] - left_h
                gain = gain_of(left_g, left_h) + gain_of(right_g, right_h) - gain_of(gs[:, -1:], hs[:, -1:])
                ns = np.bincount(slot, minlength=count * k).reshape(count, k).cumsum(axis=1)
                gain[(ns[:, :-1] < self.least) | (ns[:, -1:] - ns[:, :-1] < self.least)] = 0
                j = gain.argmax(axis=1)
                for m in np.nonzero(gain[np.arange(count), j] > best)[0]:
                    best[m], choice[m] = gain[m, j[m]], (f, int(j[m]))
            right = np.zeros(len(g), bool)
            for m, (f, j) in enumerate(choice):
                if f >= 0:
                    feature[first + m], cut[first + m] = f, self.cuts[f][j]
                    own = node == m
                    right[own] = codes[own, f] > j
            at = 2 * at + 1 + right
        leaf = at - inner
        value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
        return leaf, (feature, cut, value)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = 2 * at + 1 + ((f >= 0) & (x[rows, f] > cut[at]))
            out += value[at - len(feature)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Scores and the non-decreasing rates of y at them, by pooling neighbours that are out of order; each pool is drawn
    towards the overall rate by `prior` rows, so that no rate is 0 or 1."""
    if not len(y):
        return np.zeros(1), np.full(1, 0.5)
    order = np.argsort(score, kind="stable")
    x, inverse = np.unique(score[order], return_inverse=True)
    hits, rows = np.bincount(inverse, y[order]), np.bincount(inverse).astype(float)
    pools: list[list[float]] = []  # hits, rows, first, last
    for k in range(len(x)):
        pools.append([hits[k], rows[k], k, k])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            h, r, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + h, pools[-1][1] + r, pools[-1][2], last]
    mean = y.mean()
    at, rate = [], []
    for h, r, first, last in pools:
        value = (h + prior * mean) / (r + prior)
        at += [x[int(first)], x[int(last)]]
        rate += [value, value]
    return np.array(at), np.maximum.accumulate(np.array(rate))
