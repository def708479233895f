"""A random forest in numpy whose score is one SQL expression."""

from __future__ import annotations

import numpy as np


def _grow(x: np.ndarray, y: np.ndarray, depth: int, tries: int, least: int, rng: np.random.Generator):
    """A tree as (feature, cut, below, above) or a leaf's share of positives."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    best = None
    for f in rng.choice(x.shape[1], tries, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, hit = x[order, f], np.cumsum(y[order])
        k = np.flatnonzero(v[1:] > v[:-1]) + 1
        k = k[(k >= least) & (k <= len(y) - least)]
        if not len(k):
            continue
        a, b = hit[k - 1], hit[-1] - hit[k - 1]
        gini = a * (k - a) / k + b * (len(y) - k - b) / (len(y) - k)
        i = int(gini.argmin())
        if best is None or gini[i] < best[0]:
            best = (gini[i], int(f), float((v[k[i] - 1] + v[k[i]]) / 2))
    if best is None:
        return float((y.sum() + 0.5) / (len(y) + 1))
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, _grow(x[low], y[low], depth - 1, tries, least, rng), _grow(x[~low], y[~low], depth - 1, tries, least, rng)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 5, least: int = 4, seed: int = 1) -> list:
    """Trees on bootstrap samples, each split looking at about the square root of the features."""
    rng = np.random.Generator(np.random.PCG64(seed))
    tries = max(2, round(np.sqrt(x.shape[1])) + 1)
    out = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        out.append(_grow(x[pick], y[pick], depth, tries, least, rng))
    return out


def forest_sql(trees: list, features: list[str]) -> str:
    """The mean of the trees' leaves as nested CASEs over the features' columns."""

    def one(t) -> str:
        if not isinstance(t, tuple):
            return f"{t!r}D"
        return f"CASE WHEN {features[t[0]]} <= {t[1]!r}D THEN {one(t[2])} ELSE {one(t[3])} END"

    return "(" + " + ".join(f"({one(t)})" for t in trees) + f") / {len(trees)}D"
