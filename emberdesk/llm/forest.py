"""A small random forest: fitted with numpy on a bounded labelled table, applied as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gini_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float] | None:
    best = None
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        left = np.arange(1, len(t))
        ones = np.cumsum(t)[:-1]
        right, rest = len(t) - left, t.sum() - ones
        p, q = ones / left, rest / right
        impurity = (left * p * (1 - p) + right * q * (1 - q)) / len(t)
        ok = (v[1:] > v[:-1]) & (left >= least) & (right >= least)
        if ok.any():
            i = int(np.argmin(np.where(ok, impurity, np.inf)))
            if best is None or impurity[i] < best[0] - 1e-12:
                best = (float(impurity[i]), int(f), float((v[i] + v[i + 1]) / 2))
    return best


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, tried: int, least: int):
    if not depth or y.min() == y.max():
        return float(y.mean())
    split = _gini_split(x, y, rng.choice(x.shape[1], size=tried, replace=False), least)
    if split is None:
        return float(y.mean())
    _, f, at = split
    low = x[:, f] <= at
    return f, at, _grow(x[low], y[low], rng, depth - 1, tried, least), _grow(x[~low], y[~low], rng, depth - 1, tried, least)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, least: int = 3, seed: int = 7) -> list:
    rng = np.random.default_rng(seed)
    tried = max(1, round(x.shape[1] ** 0.5) + 1)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows].astype(float), rng, depth, tried, least))
    return out


def predict(forest: list, x: np.ndarray) -> np.ndarray:
    def one(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    return np.array([sum(one(t, row) for t in forest) / len(forest) for row in x])


def as_column(forest: list, names: list[str]) -> Column:
    """The forest's mean vote as nested conditions over the columns ``names``."""

    def expr(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(node)
        return F.when(F.col(names[node[0]]) <= node[1], expr(node[2])).otherwise(expr(node[3]))

    total = F.lit(0.0)
    for tree in forest:
        total = total + expr(tree)
    return total / len(forest)
