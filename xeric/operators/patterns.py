"""Leading patterns of a field over any number of sites, by a block Krylov subspace in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xeric.sources.scratch import join_split, written

#: Directions beyond those asked for in each block, columns of the basis before it is condensed, and rounds at most.
SPARE, MOST_COLUMNS, ROUNDS = 8, 96, 60


def _gram(table: DataFrame, columns: list[str], width: int) -> np.ndarray:
    """The sum of outer products of the rows' numbers: one small matrix a task, summed by Spark place by place."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                x = np.hstack([np.stack(pdf[c].to_numpy()) for c in columns])
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(width * width), "v": total.ravel()})

    rows = table.select(*columns).mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width * width)
    for r in rows:
        out[r["i"]] = r["v"]
    return out.reshape(width, width)


def _combined(table: DataFrame, key: str, columns: list[str], matrix: np.ndarray, out: str) -> DataFrame:
    """(key, out): the rows' numbers times a small matrix, which goes along with the task."""
    kind = dict(table.dtypes)[key]

    def run(batches):
        for pdf in batches:
            x = np.hstack([np.stack(pdf[c].to_numpy()) for c in columns]) if len(pdf) else np.zeros((0, len(matrix)))
            yield pd.DataFrame({key: pdf[key], out: list(x @ matrix)})

    return table.select(key, *columns).mapInPandas(run, f"`{key}` {kind}, `{out}` array<double>")


def _product(z: DataFrame, other: DataFrame, on: str, by: str, column: str, width: int, out: str) -> DataFrame:
    """(by, out): for each ``by`` the sum of z times the other table's numbers over ``on``."""
    sums = F.array(*[F.sum(F.col("_z") * F.col(column)[i]) for i in range(width)])
    return join_split(z, other.select(on, column), [on]).groupBy(by).agg(sums.alias(out))


def _independent(gram: np.ndarray, old: int) -> np.ndarray:
    """The matrix that turns [basis, new] into orthonormal columns orthogonal to the basis (of ``old`` columns)."""
    c, g = gram[:old, old:], gram[old:, old:]
    e, u = np.linalg.eigh(g - c.T @ c)
    keep = e > 1e-10 * max(np.trace(g) / max(len(g), 1), 1e-300)
    w = u[:, keep] / np.sqrt(e[keep])
    return np.vstack([-c @ w, w])


def leading_patterns(z: DataFrame, site: str, time: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """(site, v) with the k leading right singular vectors of z (site, time, _z, complete), and the squared singular values.

    A block of k + 8 directions, begun from hashes of the sites, is multiplied by the field and its transpose: two
    joins with sums, by time and by site. What is new in the product joins the basis, and the field on the basis is
    solved by a small matrix, until the k values stay. Only matrices of some 100 by 100 numbers reach the driver; sites
    and times stay in tables, whatever their number. With no more sites than directions the basis is whole at once.
    """
    block = k + SPARE
    start = z.select(site).distinct()
    noise = F.array(*[(F.xxhash64(F.lit(i), F.col(site).cast("string")) / 2.0**63).alias("v") for i in range(block)])
    basis = written(start.select(site, noise.alias("w")), "pattern-start")
    basis = written(_combined(basis, site, ["w"], _independent(_gram(basis, ["w"], block), 0), "q"), "patterns")
    width = len(basis.first()["q"])  # fewer if there are fewer sites
    field, new, last = None, basis.select(site, F.col("q").alias("w")), None
    fresh = width
    for _ in range(ROUNDS):
        y = written(_product(z, new, site, time, "w", fresh, "n"), "pattern-times")
        field = y.select(time, F.col("n").alias("y")) if field is None else written(field.join(y, time).select(time, F.concat("y", "n").alias("y")), "pattern-fields")
        e, u = np.linalg.eigh(_gram(field, ["y"], width))
        e, u = e[::-1], u[:, ::-1]
        top = np.maximum(e[:k], 0)
        if last is not None and len(last) == len(top) and np.allclose(top, last, rtol=1e-13, atol=1e-13 * max(top[:1], default=0)):
            break
        last = top
        if width + fresh > MOST_COLUMNS:  # go on with the best directions alone
            best = u[:, :block]
            basis, width = written(_combined(basis, site, ["q"], best, "q"), "patterns"), block
            field = written(_combined(field, time, ["y"], best, "y"), "pattern-fields")
            u, y, fresh = np.eye(block), field.select(time, F.col("y").alias("n")), block
        w = _product(z, y, time, site, "n", fresh, "w")
        both = written(basis.join(w, site), "pattern-products")
        turn = _independent(_gram(both, ["q", "w"], width + fresh), width)
        if not turn.shape[1]:
            break
        new = written(_combined(both, site, ["q", "w"], turn, "w"), "pattern-new")
        fresh = turn.shape[1]
        basis = written(basis.join(new, site).select(site, F.concat("q", "w").alias("q")), "patterns")
        width += fresh
    u = np.vstack([u, np.zeros((width - len(u), u.shape[1]))])  # a last block that was not multiplied adds nothing
    return written(_combined(basis, site, ["q"], u[:, :k], "v"), "patterns"), top


def eof(
    df: DataFrame, site: str, time: str, value: str, k: int = 3, lat: str | None = None, kaiser: bool = False, focus: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Patterns (site, pattern_i) and scores (time, score_i) of the sites' standardised series, over complete times.

    With ``lat`` the series are weighted by the root of its cosine. ``kaiser`` keeps the patterns with more than a site's
    mean variance, one at least. A pattern's sign makes its mean score over the times of ``focus`` (a condition on the
    time) positive, or its own sum where there is no focus or under three such times. Sites without a value or without
    variance have no part; times at which one of the others has no value are left out. Sites may be any in number: see
    ``leading_patterns``. Without a complete time both tables are empty. Values that repeat a site and time must not be.
    """
    w = Window.partitionBy(site)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    d = df.filter(F.col(value).isNotNull()).withColumn("_z", z if lat is None else z * F.sqrt(F.cos(F.radians(F.col(lat)))))
    d = written(d.filter("_z is not null").select(site, time, "_z"), "field")
    n_sites = d.select(site).distinct().count()
    full = d.groupBy(time).agg(F.count("*").alias("_n")).filter(F.col("_n") == n_sites).select(time)
    d = written(join_split(d, full, [time]), "complete-field")
    names = [f"{{}}_{i + 1}" for i in range(max(1, min(k, n_sites)))]
    kinds = dict(df.dtypes)
    empty = lambda key, stem: df.sparkSession.createDataFrame([], f"`{key}` {kinds[key]}, " + ", ".join(f"{n.format(stem)} double" for n in names))
    if d.isEmpty():
        return empty(site, "pattern"), empty(time, "score")
    patterns, values = leading_patterns(d, site, time, len(names))
    if kaiser:
        total = d.agg(F.sum(F.col("_z") * F.col("_z"))).first()[0]
        names = names[: max(1, int((values > total / n_sites).sum()))]
    scores = written(_product(d, patterns, site, time, "v", len(names), "s"), "scores")
    held = scores.filter(focus).agg(F.count("*"), *[F.avg(F.col("s")[i]) for i in range(len(names))]).first() if focus is not None else (0,)
    if held[0] >= 3:
        sign = [-1.0 if m < 0 else 1.0 for m in held[1:]]
    else:
        sign = [-1.0 if s < 0 else 1.0 for s in patterns.agg(*[F.sum(F.col("v")[i]) for i in range(len(names))]).first()]
    listed = lambda t, key, c, stem: t.select(key, *[(F.col(c)[i] * sign[i]).alias(n.format(stem)) for i, n in enumerate(names)])
    return listed(patterns, site, "v", "pattern"), listed(scores, time, "s", "score")
