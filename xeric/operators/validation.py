"""Corrections by several predictors, tested on stations that had no part in the fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xeric.functions.special import solve
from xeric.sources.scratch import join_split, written


def screen_ratios(df: DataFrame, observed: str, modelled: str, most: float = 3.0) -> DataFrame:
    """df with ``ratio_z``, the z of observed over modelled among all positive pairs, and ``outlier`` where |z| > most.

    Rows that are not such a pair have a null z and are no outliers, as are all rows if there are under three pairs.
    """
    o, m = F.col(observed).cast("double"), F.col(modelled).cast("double")
    ratio = F.when((o > 0) & (m > 0) & (o < float("inf")) & (m < float("inf")), o / m)
    s = df.agg(F.count(ratio).alias("n"), F.avg(ratio).alias("mean"), F.stddev_samp(ratio).alias("sd")).first()
    z = (ratio - s["mean"]) / s["sd"] if s["n"] >= 3 and s["sd"] else F.lit(None).cast("double")
    return df.withColumn("ratio_z", z).withColumn("outlier", F.coalesce(F.abs("ratio_z") > most, F.lit(False)))


def _moments(x: list[Column], y: Column) -> list[Column]:
    n = len(x)
    pairs = [F.sum(x[i] * x[j]).alias(f"_m{i}_{j}") for i in range(n) for j in range(i, n)]
    return [F.count("*").alias("_n"), *pairs, *[F.sum(x[i] * y).alias(f"_r{i}") for i in range(n)]]


def left_out_fits(df: DataFrame, station: str, response: str, predictors: list[str], least: int = 15) -> DataFrame:
    """(station, n_fit, mean, scale, coefficients): the least squares fit to all stations but one, for each station.

    Normal-equation sums are taken by station in one pass; a station's are taken off the totals, and what is left is
    solved in a column expression, so a thousand fits cost one scan. ``coefficients`` are for 1 and the predictors less
    their mean over their scale. Fits of under ``least`` rows, or of predictors that depend on each other, are null.
    """
    d = df.select(station, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([response, *predictors])]).dropna(subset=[f"_{i}" for i in range(len(predictors) + 1)])
    k = len(predictors)
    at = d.agg(*[f(f"_{i + 1}") for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    mean = [at[2 * i] or 0.0 for i in range(k)]
    scale = [at[2 * i + 1] or 1.0 for i in range(k)]
    x = [F.lit(1.0), *[(F.col(f"_{i + 1}") - mean[i]) / scale[i] for i in range(k)]]
    sums = written(d.groupBy(station).agg(*_moments(x, F.col("_0"))), "station-sums")
    names = [c for c in sums.columns if c != station]
    total = sums.agg(*[F.sum(c).alias(c) for c in names]).first()
    left = {c: F.lit(total[c]) - F.col(c) for c in names}
    rows = [F.array(*[left[f"_m{min(i, j)}_{max(i, j)}"] for j in range(k + 1)], left[f"_r{i}"]) for i in range(k + 1)]
    listed = lambda v: F.array(*[F.lit(float(e)) for e in v])
    fit = F.when(left["_n"] >= least, solve(F.array(*rows), k + 1))
    return sums.select(station, left["_n"].alias("n_fit"), listed(mean).alias("mean"), listed(scale).alias("scale"), fit.alias("coefficients"))


def left_out_predictions(df: DataFrame, station: str, response: str, predictors: list[str], raw: str, least: int = 15) -> DataFrame:
    """df's complete rows with ``predicted``: the fit without the row's own station, 0 at least; raw where there is none."""
    whole = df.dropna(subset=[response, *predictors])
    d = join_split(whole, left_out_fits(df, station, response, predictors, least), [station])
    x = F.array(F.lit(1.0), *[(F.col(c).cast("double") - F.col("mean")[i]) / F.col("scale")[i] for i, c in enumerate(predictors)])
    dot = F.aggregate(F.zip_with(x, "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = F.when(F.col("coefficients").isNotNull(), F.greatest(F.lit(0.0), dot)).otherwise(F.col(raw).cast("double"))
    return d.withColumn("predicted", out).drop("mean", "scale", "coefficients")


def transfer_skill(df: DataFrame, station: str, response: str, raw: str, models: dict[str, list[str]], least: int = 15) -> DataFrame:
    """(model, n, n_stations, rmse, bias, rank): how well each model does on stations left out, "none" being raw itself.

    All are scored on the rows that are complete for every model, so that they are compared on the same ones; rank 1 has
    the smallest error, of equals the name that comes first.
    """
    every = sorted({c for m in models.values() for c in m})
    d = written(df.dropna(subset=[station, response, raw, *every]), "complete-rows")
    scored = d.select(station, F.lit("none").alias("model"), F.col(response).cast("double").alias("_o"), F.col(raw).cast("double").alias("_p"))
    for name, predictors in models.items():
        p = left_out_predictions(d, station, response, predictors, raw, least)
        scored = scored.unionByName(p.select(station, F.lit(name).alias("model"), F.col(response).cast("double").alias("_o"), F.col("predicted").alias("_p")))
    error = F.col("_p") - F.col("_o")
    by = scored.groupBy("model", station).agg(F.count("*").alias("n"), F.sum(error * error).alias("_s"), F.sum(error).alias("_e"))
    g = by.groupBy("model").agg(F.sum("n").alias("n"), F.count("*").alias("n_stations"), F.sqrt(F.sum("_s") / F.sum("n")).alias("rmse"), (F.sum("_e") / F.sum("n")).alias("bias"))
    rows = sorted(g.collect(), key=lambda r: (r["rmse"], r["model"]))  # one a model
    ranked = [(*r, i) for i, r in enumerate(rows, 1)]
    return df.sparkSession.createDataFrame(ranked, "model string, n long, n_stations long, rmse double, bias double, rank int")
