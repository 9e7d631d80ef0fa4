"""Gradient-boosted trees small enough to become an expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float) -> tuple | float:
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if not depth:
        return leaf
    best = (1e-6, -1, 0.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(ch[at] >= least) & (ch[-1] - ch[at] >= least)]
        if len(at):
            gain = cg[at] ** 2 / (ch[at] + 1) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), j, float((v[at[i]] + v[at[i] + 1]) / 2))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], g[low], h[low], depth - 1, least), _grow(x[~low], g[~low], h[~low], depth - 1, least)


def predict(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, t, low, high = tree
    return np.where(x[:, j] <= t, predict(low, x), predict(high, x))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 16, depth: int = 3, rate: float = 0.4, least: float = 0.5) -> list:
    """Trees whose summed outputs are the log-odds of ``y`` = 1 (Newton steps on logistic loss)."""
    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, p - y, p * (1 - p), depth, least)
        trees.append(_scaled(tree, rate))
        score += predict(trees[-1], x)
    return trees


def _scaled(tree: tuple | float, rate: float) -> tuple | float:
    return tree * rate if isinstance(tree, float) else (tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate))


def expression(trees: list, features: list[Column]) -> Column:
    """The summed outputs as one expression over the feature columns."""

    def one(tree: tuple | float) -> Column:
        return F.lit(tree) if isinstance(tree, float) else F.when(features[tree[0]] <= tree[1], one(tree[2])).otherwise(one(tree[3]))

    total = F.lit(0.0)
    for tree in trees:
        total = total + one(tree)
    return total
