"""Additive models: smooth terms, their pairwise interactions and cyclic terms, by penalised least squares over one pass of sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xeric.sources.scratch import written

#: Coefficients at most: the driver solves with matrices of this order.
MOST_COEFFICIENTS = 1_500
#: Smoothing parameters that are tried for each term, and how often all terms are gone through.
PENALTIES = tuple(10.0**e for e in range(-4, 6))
SWEEPS = 4
#: The cubic B-spline with evenly spaced knots at the distance c from its middle.
CUBIC = "CASE WHEN c < 1 THEN (4 - 6 * c * c + 3 * c * c * c) / 6 WHEN c < 2 THEN (2 - c) * (2 - c) * (2 - c) / 6 ELSE 0D END"
#: Weight of the identity in a penalty, by which a term that the data don't support shrinks to nothing.
SHRINKAGE = 0.01


@dataclass(frozen=True)
class Basis:
    """Cubic B-splines on evenly spaced knots between low and high; cyclic ones meet at the ends."""

    variable: str
    size: int
    low: float
    high: float
    cyclic: bool = False

    def column(self) -> Column:
        """The ``size`` functions' values, which add up to 1. Values beyond the ends count as at the end; null and NaN give null."""
        x = f"CAST(`{self.variable.replace('`', '``')}` AS DOUBLE)"
        share = f"({x} - {_number(self.low)}) / {_number((self.high - self.low) or 1.0)}"
        place = f"pmod({share} * {self.size} - j + 4, {_number(self.size)})" if self.cyclic else f"(least(greatest({share}, 0D), 1D) * {self.size - 3} - j + 3)"
        values = f"transform(transform(sequence(0, {self.size - 1}), j -> abs({place} - 2)), c -> {CUBIC})"
        return F.expr(f"CASE WHEN {x} IS NOT NULL AND NOT isnan({x}) THEN {values} END")


def _number(v: float) -> str:
    return f"({float(v)!r}D)"


@dataclass(frozen=True)
class Term:
    """A term's name, the numbers of its bases (two of them for an interaction) and the place of its coefficients."""

    name: str
    bases: tuple[int, ...]
    start: int
    stop: int


@dataclass(frozen=True)
class AdditiveFit:
    """A fitted model. ``means`` are the bases' mean values, which are taken off, so that each term is centred."""

    response: str
    bases: tuple[Basis, ...]
    means: tuple[tuple[float, ...], ...]
    terms: tuple[Term, ...]
    coefficients: np.ndarray
    errors: np.ndarray
    edf: np.ndarray
    n: int
    penalties: tuple[float, ...]
    gcv: float
    explained: float

    def table(self, spark: SparkSession) -> DataFrame:
        """(term, place, coefficient, error, edf): one row a coefficient, the intercept as place 0 of its own term."""
        rows = [("intercept", 0, *(float(a[0]) for a in (self.coefficients, self.errors, self.edf)))]
        rows += [(t.name, i - t.start, float(self.coefficients[i]), float(self.errors[i]), float(self.edf[i])) for t in self.terms for i in range(t.start, t.stop)]
        return spark.createDataFrame(rows, "term string, place int, coefficient double, error double, edf double")


def _centred(basis: Basis, mean) -> Column:
    """All functions but the last, less their means: with an intercept the last says nothing new."""
    return F.slice(F.zip_with(basis.column(), F.array(*[F.lit(float(m)) for m in mean]), lambda v, m: v - m), 1, basis.size - 1)


def _penalty(basis: Basis) -> np.ndarray:
    """Squared second differences of neighbouring coefficients, the last of which is 0."""
    k = basis.size
    d = np.diff(np.eye(k), 2, axis=0) if not basis.cyclic else np.eye(k) - 2 * np.roll(np.eye(k), 1, axis=1) + np.roll(np.eye(k), 2, axis=1)
    return (d.T @ d)[: k - 1, : k - 1]


def _design(blocks: list[np.ndarray], terms: tuple[Term, ...], width: int) -> np.ndarray:
    x = np.ones((len(blocks[0]), width))
    for t in terms:
        a = blocks[t.bases[0]]
        x[:, t.start : t.stop] = a if len(t.bases) == 1 else (a[:, :, None] * blocks[t.bases[1]][:, None, :]).reshape(len(a), -1)
    return x


def _sums(rows: DataFrame, terms: tuple[Term, ...], n_bases: int, width: int) -> np.ndarray:
    """Products of all columns of the design and the response, summed: a triangle a task, added place by place."""
    upper = np.triu_indices(width + 1)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width + 1))
        seen = False
        for pdf in batches:
            if len(pdf):
                seen = True
                x = _design([np.stack(pdf[f"_b{i}"].to_numpy()) for i in range(n_bases)], terms, width)
                x = np.column_stack([x, pdf["_y"].to_numpy()])
                total += x.T @ x
        if seen:
            yield pd.DataFrame({"i": np.arange(len(upper[0])), "v": total[upper]})

    out = np.zeros((width + 1, width + 1))
    for r in rows.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # as many as the triangle has places
        a, b = upper[0][r["i"]], upper[1][r["i"]]
        out[a, b] = out[b, a] = r["v"]
    return out


def fit_additive(
    df: DataFrame, response: str, smooths: list[str], interactions: list[tuple[str, str]] = (), cyclic: dict[str, tuple[float, float]] | None = None, k_main: int = 8, k_pair: int = 6, k_cyclic: int = 6
) -> AdditiveFit | None:
    """response ~ smooths + products of their centred bases + cyclic terms, smoothing chosen by generalised cross-validation.

    The model's columns are written once and passed over three times: ranges, the bases' means, and the sums of products of the design's columns.
    The latter are all that a fit needs, for every smoothing parameter: the grid of PENALTIES is tried on them in the
    driver, for all terms together and then term by term, with matrices of as many rows as the model has coefficients
    (MOST_COEFFICIENTS at most), whatever the number of rows. Penalties are squared second differences with a share of
    the identity, so a fit exists for any data, also for predictors that are constant or copies of each other. Rows with a
    null, NaN or infinity in any variable take no part; without a row there is no fit (None).
    """
    cyclic = cyclic or {}
    names = [response, *smooths, *cyclic]
    finite = lambda c: F.col(c).cast("double").isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    for c in names:
        rows = rows.filter(finite(c))
    rows = written(rows, "model-rows")
    ends = rows.agg(F.count("*").alias("n"), F.avg(response).alias("y"), *[f(c).alias(f"{f.__name__}_{c}") for c in smooths for f in (F.min, F.max)]).first()
    if not ends["n"]:
        return None
    between = lambda c, k: Basis(c, k, ends[f"min_{c}"], ends[f"max_{c}"])
    paired = [c for c in smooths if any(c in p for p in interactions)]
    bases = (*(between(c, k_main) for c in smooths), *(Basis(c, k_cyclic, *e, cyclic=True) for c, e in cyclic.items()), *(between(c, k_pair) for c in paired))
    n_single = len(smooths) + len(cyclic)
    terms, at = [], 1
    for i in range(n_single):
        terms.append(Term(f"s({bases[i].variable})", (i,), at, at := at + bases[i].size - 1))
    for a, b in interactions:
        i, j = (n_single + paired.index(c) for c in (a, b))
        terms.append(Term(f"ti({a},{b})", (i, j), at, at := at + (bases[i].size - 1) * (bases[j].size - 1)))
    if at > MOST_COEFFICIENTS:
        raise ValueError(f"{at} coefficients: at most {MOST_COEFFICIENTS}")
    every = rows.select(F.posexplode(F.concat(*[b.column() for b in bases])).alias("place", "v")).groupBy("place").agg(F.avg("v").alias("v"))
    average = {r["place"]: r["v"] for r in every.collect()}  # one row a basis function
    starts = np.cumsum([0, *[b.size for b in bases]])
    means = tuple(tuple(average[int(starts[i]) + j] for j in range(b.size)) for i, b in enumerate(bases))
    blocks = rows.select((F.col(response) - ends["y"]).alias("_y"), *[_centred(b, means[i]).alias(f"_b{i}") for i, b in enumerate(bases)])
    gram = _sums(blocks, tuple(terms), len(bases), at)
    return _choose(gram, response, bases, means, tuple(terms), ends["n"], ends["y"])


def _choose(gram: np.ndarray, response: str, bases, means, terms: tuple[Term, ...], n: int, centre: float) -> AdditiveFit:
    xx, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    p = len(xx)
    parts = []
    for t in terms:
        at = slice(t.start, t.stop)
        s = _penalty(bases[t.bases[0]])
        if len(t.bases) == 2:
            other = _penalty(bases[t.bases[1]])
            s = np.kron(s, np.eye(len(other))) + np.kron(np.eye(len(s)), other)
        whole = np.zeros((p, p))
        whole[at, at] = (s / np.trace(s) + SHRINKAGE * np.eye(len(s)) / len(s)) * max(np.trace(xx[at, at]), 1e-12 * n)  # on the data's scale
        parts.append(whole)

    def tried(penalties: tuple[float, ...]):
        whole = np.linalg.inv(xx + sum(a * s for a, s in zip(penalties, parts, strict=True)))
        beta = whole @ xy
        edf = np.diag(whole @ xx)
        rss = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
        left = n - edf.sum()
        return (n * rss / left**2 if left > 1e-9 else np.inf), beta, edf, rss, whole, penalties

    least = lambda found: min(found, key=lambda f: (f[0], [-a for a in f[5]]))  # noqa: E731  of equals the smoothest
    best = least(tried((a,) * len(terms)) for a in PENALTIES)
    for _ in range(SWEEPS):
        before = best[5]
        for i in range(len(terms)):
            best = least(tried((*best[5][:i], a, *best[5][i + 1 :])) for a in PENALTIES)
        if best[5] == before:
            break
    gcv, beta, edf, rss, whole, chosen = best
    beta = beta.copy()
    error = np.sqrt(np.maximum(np.diag(whole), 0) * rss / max(n - edf.sum(), 1e-9))
    beta[0] += centre
    return AdditiveFit(response, tuple(bases), means, terms, beta, error, edf, n, chosen, float(gcv), float(1 - rss / yy) if yy > 0 else 0.0)


def _dot(values: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)


def _value(fit: AdditiveFit, term: Term) -> Column:
    """A term's value from the centred bases in columns _b0, _b1 and so on."""
    listed = lambda values: F.array(*[F.lit(float(v)) for v in values])
    c = fit.coefficients[term.start : term.stop]
    first = F.col(f"_b{term.bases[0]}")
    if len(term.bases) == 1:
        return _dot(first, listed(c))
    second = F.col(f"_b{term.bases[1]}")
    return _dot(first, F.array(*[_dot(second, listed(r)) for r in c.reshape(fit.bases[term.bases[0]].size - 1, -1)]))


def predict_terms(df: DataFrame, fit: AdditiveFit) -> DataFrame:
    """df with a column for each term, by its name, and ``predicted``, their sum with the intercept, all in column expressions.

    Beyond the fitted range a smooth keeps its end's value. A null or NaN in a term's variable gives null. Columns of df
    with a term's name are replaced.
    """
    keep = [c for c in df.columns if c not in {t.name for t in fit.terms} | {"predicted"}]
    d = df.select(*keep, *[_centred(b, m).alias(f"_b{i}") for i, (b, m) in enumerate(zip(fit.bases, fit.means, strict=True))])
    for t in fit.terms:
        d = d.withColumn(t.name, _value(fit, t))
    whole = sum((F.col(f"`{t.name}`") for t in fit.terms), F.lit(float(fit.coefficients[0])))
    return d.select(*keep, *[F.col(f"`{t.name}`") for t in fit.terms], whole.alias("predicted"))


def variance_shares(df: DataFrame, fit: AdditiveFit) -> DataFrame:
    """(term, edf, variance, share): each term's variance over the rows, and its share of the terms' sum; null shares if all are 0."""
    d = predict_terms(df, fit)
    got = d.agg(*[F.var_pop(F.col(f"`{t.name}`")).alias(str(i)) for i, t in enumerate(fit.terms)]).first()  # one row
    values = [got[i] or 0.0 for i in range(len(fit.terms))]
    rows = [(t.name, float(fit.edf[t.start : t.stop].sum()), v, v / sum(values) if sum(values) > 0 else None) for t, v in zip(fit.terms, values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, edf double, variance double, share double")
