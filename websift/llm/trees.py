"""Bagged decision trees in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Tree(NamedTuple):
    """Arrays by node: feature (-1 at a leaf), threshold, left child, right child, share of label 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def _best_split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[int, float] | None:
    """The split with the lowest Gini impurity, ties to the first feature and lowest threshold."""
    n = len(y)
    best = None
    base = y.mean() * (1 - y.mean()) * n
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        ones = np.cumsum(t)[:-1]
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if not ok.any():
            continue
        a, b = ones / k, (t.sum() - ones) / (n - k)
        cost = np.where(ok, k * a * (1 - a) + (n - k) * b * (1 - b), np.inf)
        i = int(cost.argmin())
        if cost[i] < base - 1e-9 and (best is None or cost[i] < best[0] - 1e-12):
            best = (cost[i], f, (v[i] + v[i + 1]) / 2)
    return None if best is None else (best[1], float(best[2]))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = 6, least: int = 3, features: int | None = None) -> Tree:
    nodes: list[list] = []

    def add(idx: np.ndarray, level: int) -> int:
        k = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[idx].mean())])
        if level < depth and 0 < y[idx].mean() < 1 and len(idx) >= 2 * least:
            chosen = np.arange(x.shape[1]) if features is None else np.sort(rng.choice(x.shape[1], features, replace=False))
            if (split := _best_split(x[np.ix_(idx, chosen)], y[idx], least)) is not None:
                f, t = int(chosen[split[0]]), split[1]
                go = x[idx, f] <= t
                nodes[k][:2] = f, t
                nodes[k][2] = add(idx[go], level + 1)
                nodes[k][3] = add(idx[~go], level + 1)
        return k

    add(np.arange(len(y)), 0)
    return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 6, seed: int = 7) -> list[Tree]:
    """One tree for each bootstrap sample, half of it of each label, so that rare kinds of the rare label are seen; no rows give no trees."""
    rng = np.random.default_rng(seed)
    if not len(y):
        return []
    k = max(1, int(np.ceil(x.shape[1] * 0.65)))
    out = []
    for _ in range(trees):
        sides = [np.flatnonzero(y == v) for v in (0, 1) if (y == v).any()]
        pick = np.concatenate([rng.choice(side, -(-len(y) // len(sides))) for side in sides])
        out.append(grow(x[pick], y[pick].astype(float), rng, depth, features=k))
    return out


def predict(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    """The mean over the trees; 0 without trees."""
    total = np.zeros(len(x))
    for t in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = t.feature[at] >= 0
            if not inner.any():
                break
            i = np.flatnonzero(inner)
            go = x[i, t.feature[at[i]]] <= t.threshold[at[i]]
            at[i] = np.where(go, t.left[at[i]], t.right[at[i]])
        total += t.value[at]
    return total / max(len(forest), 1)
