"""Gradient boosted trees for two classes.

Features are cut into at most ``BINS`` quantile bins; each tree is grown level
by level on sums of gradients per bin, which are all that growing needs to see:
``Held`` takes them over rows in memory, a Spark job over rows of any number.
Gradients are rounded to whole multiples of ``1 / GRAIN`` first, so the sums are
exact and neither their order nor the place where they are taken changes a tree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

BINS = 32
#: Values of a binned feature: quantiles 0, 1 / BINS, ..., 1.
WIDTH = BINS + 1
GRAIN = 2.0**24


@dataclass(frozen=True)
class Tree:
    """A full binary tree: node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    depth: int

    def place(self, x: np.ndarray, level: int) -> np.ndarray:
        """Which of the 2**level nodes of a level each row reaches."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(level):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.limit[at])
        return at - (2**level - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.place(x, self.depth)]


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: Sums of gradients and of their slopes, in units of 1 / GRAIN: of the trees so far, a tree
#: grown to a level and that level, an array of 2 x features x nodes x WIDTH.
Sums = Callable[[tuple[Tree, ...], Tree, int], np.ndarray]


def cut_points(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where a feature is cut, from its distinct values in order and how often each occurs."""
    if len(values) > BINS:
        place = np.floor(np.linspace(0, 1, BINS + 1) * (counts.sum() - 1))
        values = np.unique(values[np.searchsorted(np.cumsum(counts), place, side="right")])
    return values[:-1]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


class Held:
    """``Sums`` over rows in memory; a row counts ``weight`` times."""

    def __init__(self, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, start: float) -> None:
        self.bins, self.label, self.weight = bins, label, weight
        self.margin, self.seen = np.full(len(label), start), 0

    def __call__(self, trees: tuple[Tree, ...], tree: Tree, level: int) -> np.ndarray:
        for t in trees[self.seen :]:
            self.margin = self.margin + t.predict(self.bins)
        self.seen = len(trees)
        p, n = sigmoid(self.margin), 2**level
        grad, hess = (np.rint(v * GRAIN) * self.weight for v in (p - self.label, p * (1 - p)))
        node, out = tree.place(self.bins, level) * WIDTH, np.empty((2, self.bins.shape[1], n * WIDTH))
        for f in range(self.bins.shape[1]):
            key = node + self.bins[:, f]
            out[0, f], out[1, f] = np.bincount(key, grad, n * WIDTH), np.bincount(key, hess, n * WIDTH)
        return out.reshape(2, -1, n, WIDTH)


def grow(cuts: list[np.ndarray], trees: tuple[Tree, ...], sums: Sums, depth: int, shrink: float, rate: float) -> Tree:
    """The next tree, its limits numbers of bins."""
    inner = 2**depth - 1
    feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
    for level in range(depth):
        first, n = 2**level - 1, 2**level
        level_g, level_h = sums(trees, Tree(feature, limit, np.zeros(inner + 1), depth), level) / GRAIN
        best = np.zeros(n)
        # Without a split all rows of a node go left.
        left = np.stack([level_g[0].sum(axis=1), level_h[0].sum(axis=1)])
        total = left.copy()
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            g, h = (v[f, :, : len(edges) + 1].cumsum(axis=1) for v in (level_g, level_h))
            total_g, total_h = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + shrink) + (total_g - g) ** 2 / (total_h - h + shrink) - total_g**2 / (total_h + shrink)
            k = gain[:, :-1].argmax(axis=1)
            found = gain[np.arange(n), k]
            better = np.flatnonzero(found > best + 1e-9)
            best[better] = found[better]
            feature[first + better], limit[first + better] = f, k[better]
            left[:, better] = g[better, k[better]], h[better, k[better]]
    g, h = np.stack([left, total - left], axis=2).reshape(2, inner + 1)
    return Tree(feature, limit, -rate * g / (h + shrink), depth)


def first_margin(share: float) -> float:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def boosted(cuts: list[np.ndarray], start: float, sums: Sums, rounds: int = 60, depth: int = 3, rate: float = 0.2, shrink: float = 1.0) -> Model:
    """Boosted trees from sums alone."""
    trees: tuple[Tree, ...] = ()
    for _ in range(rounds):
        trees += (grow(cuts, trees, sums, depth, shrink, rate),)

    def of_values(t: Tree) -> Tree:
        limit = [cuts[f][int(k)] if np.isfinite(k) else np.inf for f, k in zip(t.feature, t.limit, strict=True)]
        return Tree(t.feature, np.array(limit), t.value, t.depth)

    return Model(start, tuple(map(of_values, trees)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, shrink: float = 1.0) -> Model:
    """Boosted trees for labels 0 and 1 of rows in memory."""
    cuts = [cut_points(*np.unique(x[:, f], return_counts=True)) for f in range(x.shape[1])]
    start = first_margin(float(y.mean()))
    return boosted(cuts, start, Held(binned(x, cuts), y, np.ones(len(y)), start), rounds, depth, rate, shrink)
