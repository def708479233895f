"""Embedding whitening: principal components of exactly centred integer vectors, each scaled to variance one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

STEP, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries of at least this size are no numbers to whiten: their steps would not be exact in a double.
MOST_ENTRY = 2.0**42
#: Eigenvalues below this share of the largest are rounding, not variance.
LEAST_SHARE = 1e-12


def fit_list(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): the vectors without a null or non-finite entry, as whole steps."""
    c = F.transform(vector, lambda e: e.cast("double"))
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < MOST_ENTRY))
    steps = F.transform(c, lambda e: F.floor(e * STEP).cast("long") + SHIFT)
    return vectors.filter(fine).select(F.col(key), steps.alias("x"))


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, n, pos, s, low, high): a task's sums in each dimension, by length of vector."""
    found: dict[int, list] = {}
    for b in batches:
        lists = b["x"]
        offsets = lists.offsets.to_numpy()
        flat, size = lists.values.to_numpy(), np.diff(offsets)
        for d in np.unique(size).tolist():
            x = flat[offsets[:-1][size == d][:, None] + np.arange(d)]
            n, s, low, high = found.get(d, (0, 0, 1 << 62, -(1 << 62)))
            # Sums of parts of 32 bits each, put together as Python integers, so that none can overflow.
            total = (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
            found[d] = (n + len(x), s + total, min(low, int(x.min())), max(high, int(x.max())))
    for d, (n, s, low, high) in found.items():
        yield pa.RecordBatch.from_pydict({"size": [d] * d, "n": [n] * d, "pos": list(range(d)), "s": [str(v) for v in s], "low": [low] * d, "high": [high] * d}, schema=_PARTIAL)


_PARTIAL = pa.schema([("size", pa.int32()), ("n", pa.int64()), ("pos", pa.int32()), ("s", pa.string()), ("low", pa.int64()), ("high", pa.int64())])


def _centred(x: np.ndarray, n: int, s: np.ndarray, exact: bool) -> np.ndarray:
    """n * x - s, in longs where they hold it and in Python integers otherwise."""
    return x * n - s.astype(np.int64) if exact else x.astype(object) * n - s


def gram(rows: DataFrame, column: str) -> np.ndarray:
    """The sum of outer products of a column of double arrays, by Spark's RowMatrix: one matrix of d by d a task is merged."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error): each vector's scaled places on the leading components.

    An entry c becomes x = floor(1024 c) + 100000. All vectors are the fit list: with n of them and sums S, the rows
    (n x - S) / n are exact before their one rounding, RowMatrix sums their outer products, and the eigenvectors of that
    sum over n are found in the driver (d by d numbers, d being the vectors' length) and sent to all tasks. ``whitened``
    and ``explained`` are arrays by component, from the largest eigenvalue; ``deviation`` is the sum of (n x - S)^2 as a
    decimal of up to 38 digits; ``identity_error`` is measured on the whitened rows themselves.

    Vectors that are null, empty or hold an entry that is null, not finite or of 2^42 or more are dropped, as are those
    not of the commonest length (of equally common ones the longest). Components without variance (a single row, equal
    rows) have a null place. Rows that repeat an id are rows of their own; other columns are ignored; an empty table
    gives an empty one.
    """
    fit = fit_list(vectors, key, vector)
    part = fit.select("x").mapInArrow(_partial_sums, "size int, n long, pos int, s string, low long, high long")
    sums = part.groupBy("size", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    kind = dict(vectors.dtypes)[key]
    schema = f"{key} {kind}, n long, deviation decimal(38,0), whitened array<double>"
    tail = "explained array<double>, identity_error double"
    # One row a dimension of the commonest length.
    best = sums.groupBy("size").agg(F.max("n").alias("n")).orderBy(F.col("n").desc(), F.col("size").desc()).limit(1)
    dims = sums.join(F.broadcast(best.select("size")), "size").orderBy("pos").collect()
    if not dims:
        return vectors.sparkSession.createDataFrame([], f"{schema}, {tail}")
    n, d = dims[0]["n"], len(dims)
    s = np.array([int(r["s"]) for r in dims], object)
    reach = max(n * max(abs(r["low"]), abs(r["high"])) + abs(int(r["s"])) for r in dims)
    exact, small = reach < 1 << 62, reach < 1 << 28  # squares of small ones add up in a long for 128 dimensions
    small = small and d <= 128

    def centre(batches):
        for b in batches:
            x = b["x"].flatten().to_numpy().reshape(-1, d)
            v = _centred(x, n, s, exact)
            rows = (v / n).astype(float)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), d).cast(pa.list_(pa.float64()))], ["v"])

    rows = fit.filter(F.size("x") == d)
    e, u = np.linalg.eigh(gram(rows.select("x").mapInArrow(centre, "v array<double>"), "v") / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, d)
    alive = e[:k] > LEAST_SHARE * max(float(e[0]), 0.0)
    explained = [float(v) for v in e[:k] / e.sum()] if e[0] > 0 else [None] * k
    shared = vectors.sparkSession.sparkContext.broadcast(u[:, :k] / np.sqrt(np.where(alive, e[:k], 1.0)))

    def project(batches):
        for pdf in batches:
            x = np.stack(pdf["x"].to_list()) if len(pdf) else np.empty((0, d), np.int64)
            v = _centred(x, n, s, exact)
            square = (v * v).sum(1) if small else (v.astype(object) ** 2).sum(1)
            w = (v / n).astype(float) @ shared.value
            places = [[float(q) if a else None for q, a in zip(row, alive, strict=True)] for row in w.tolist()]
            yield pd.DataFrame({key: pdf[key], "n": n, "deviation": [str(q) for q in square.tolist()], "whitened": places})

    text = schema.replace("decimal(38,0)", "string")
    out = rows.mapInPandas(project, text).withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))
    out = materialise(out, "whitened")
    error = identity_error(out, n, np.flatnonzero(alive).tolist())
    listed = F.array(*[F.lit(v).cast("double") for v in explained])
    return out.withColumns({"explained": listed, "identity_error": F.lit(error).cast("double")})


def identity_error(whitened: DataFrame, n: int, alive: list[int]) -> float | None:
    """The largest absolute entry of the whitened rows' covariance (over n, centred) minus the identity."""
    if not alive:
        return None
    places = [F.col("whitened")[i] for i in alive]
    mean = whitened.agg(*[F.avg(p) for p in places]).first()
    centred = F.array(*[p - F.lit(m) for p, m in zip(places, mean, strict=True)])
    cov = gram(whitened.select(centred.alias("v")), "v") / n
    return float(np.abs(cov - np.eye(len(alive))).max())


def by_component(rows: DataFrame, key: str) -> DataFrame:
    """A row for each vector and component, numbered from 1; the deviation as a long (null if a long cannot hold it)."""
    long = F.col("deviation").try_cast("long")
    each = rows.select(key, "n", long.alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"))
    return each.select(key, (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return by_component(whiten(vectors), "vec_id")
