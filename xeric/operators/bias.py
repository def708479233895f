"""Corrections of a gridded series towards stations: the monthly tier's forms and monotone quantile mapping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _held(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(c, high), low)


def bias_tier(pairs: DataFrame, entity: list[str], model: str = "x", station: str = "y", time: str = "month", full_weight: int = 5, select_from: int = 6, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Correction of each entity's calendar months: the form with the least error of ratio, offset and line.

    Medians of station / model and station - model by calendar month are drawn towards those of all months with weight
    min(1, n / ``full_weight``). The ratio is held to ``low``..``high`` and the offset to the month's median model value
    times (bound - 1), as are the line's slope and intercept. Under ``select_from`` pairs the ratio is taken. Pairs with
    a null are left out; a prior of fewer than three pairs is 1 and 0; without a positive median the offset is not held.

    Returns ``entity, cal_month, n, form, factor, offset, b0, b1``. One shuffle by entity and month; medians are exact.
    """
    x, y = F.col("_x"), F.col("_y")
    both = (x > 0) & (y > 0)
    rows = pairs.select(*entity, F.month(time).alias("cal_month"), F.col(model).cast("double").alias("_x"), F.col(station).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    prior = rows.groupBy(*entity).agg(
        F.when(F.sum(both.cast("int")) >= 3, F.median(F.when(both, y / x))).otherwise(1.0).alias("_prior_ratio"),
        F.when(F.count("*") >= 3, F.median(y - x)).otherwise(0.0).alias("_prior_diff"),
    )
    line = F.count("*") >= 3
    months = rows.groupBy(*entity, "cal_month").agg(
        F.count("*").alias("n"), F.median(F.when(both, y / x)).alias("_ratio"), F.median(y - x).alias("_diff"), F.median(x).alias("_mid"),
        F.when(line & (F.stddev_samp(x) > 1e-8), F.regr_slope(y, x)).alias("_b1"), F.when(line & (F.stddev_samp(x) > 1e-8), F.regr_intercept(y, x)).alias("_b0"),
    )
    w = F.least(F.lit(1.0), F.col("n") / full_weight)
    m = months.join(prior, entity)
    a, b = F.when(F.col("_mid") > 0, F.col("_mid") * (low - 1)), F.when(F.col("_mid") > 0, F.col("_mid") * (high - 1))
    bound = lambda c: F.when(F.col("_mid") > 0, _held(c, a, b)).otherwise(c)
    m = m.select(
        *entity, "cal_month", "n",
        _held(w * F.coalesce("_ratio", "_prior_ratio") + (1 - w) * F.col("_prior_ratio"), F.lit(low), F.lit(high)).alias("factor"),
        bound(w * F.col("_diff") + (1 - w) * F.col("_prior_diff")).alias("offset"),
        F.when(F.col("_b0").isNotNull(), bound(F.col("_b0"))).alias("b0"), F.when(F.col("_b1").isNotNull(), _held(F.col("_b1"), F.lit(low), F.lit(high))).alias("b1"),
    )
    off = lambda fit: F.avg((fit - y) * (fit - y))
    errors = rows.join(m, [*entity, "cal_month"]).groupBy(*entity, "cal_month").agg(
        off(x * F.col("factor")).alias("_m"), off(x + F.col("offset")).alias("_a"), off(F.col("b0") + F.col("b1") * x).alias("_l"))
    least = F.least("_m", "_a", "_l")
    form = F.when((F.col("n") < select_from) | (F.col("_m") == least), "ratio").when(F.col("_a") == least, "offset").otherwise("line")
    return m.join(errors, [*entity, "cal_month"]).select(*entity, "cal_month", "n", form.alias("form"), "factor", "offset", "b0", "b1")


def monotone_polynomial(x: np.ndarray, y: np.ndarray, points: int = 50) -> tuple[np.ndarray, float] | None:
    """Coefficients (highest power first) and leave-one-out error of the best polynomial that neither falls nor is negative.

    Degrees up to min(3, max(1, (n - 1) // 3)), n - 2 at most, are tried; residuals left out come from the hat matrix,
    without refitting. A degree is passed over where one point all but fixes the curve at its own place.
    """
    n = len(x)
    if n < 3 or np.ptp(x) <= 0:
        return None
    best = None
    grid = np.linspace(x.min(), x.max(), points)
    for degree in range(min(3, n - 2, max(1, (n - 1) // 3)), 0, -1):
        basis = np.vander((x - x.mean()) / x.std(), degree + 1)
        q, r = np.linalg.qr(basis)
        if np.abs(np.diag(r)).min() < 1e-10:
            continue
        c = np.linalg.solve(r, q.T @ y)
        shape = np.vander((grid - x.mean()) / x.std(), degree + 1) @ c
        if (np.diff(shape) < -1e-6).any() or (shape < -1e-6).any():
            continue
        free = 1 - (q * q).sum(1)
        if (free < 1e-6).any():
            continue
        error = float(np.sqrt((((y - basis @ c) / free) ** 2).mean()))
        if best is None or error < best[1] - 1e-12:
            best = (c, error)
    return best


def quantile_mapping(pairs: DataFrame, entity: list[str], model: str = "x", station: str = "y", time: str = "month") -> DataFrame:
    """Monotone polynomial from sorted model to sorted station values by entity and calendar month, applied to each row.

    Returns ``entity, time, mapped, degree, loo_rmse``; where no polynomial is fit the value stays and degree is 0.
    Pairs with a null, a non-finite value or a negative model value fit nothing. A group is one calendar month's record, whose size doesn't grow with the number of entities.
    """
    d = pairs.select(*entity, F.col(time).alias("month"), F.month(time).alias("_m"), F.col(model).cast("double").alias("x"), F.col(station).cast("double").alias("y"))
    kinds = dict(d.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = np.isfinite(pdf["x"]) & np.isfinite(pdf["y"]) & (pdf["x"] >= 0)
        x, y = np.sort(pdf.loc[ok, "x"].to_numpy()), np.sort(pdf.loc[ok, "y"].to_numpy())
        fit = monotone_polynomial(x, y)
        out = pdf[[*entity, "month"]].copy()
        if fit is None:
            return out.assign(mapped=pdf["x"], degree=0, loo_rmse=None)
        z = (np.clip(pdf["x"].to_numpy(), x.min(), x.max()) - x.mean()) / x.std()
        return out.assign(mapped=np.polyval(fit[0], z), degree=len(fit[0]) - 1, loo_rmse=fit[1])

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*entity, "month"]) + ", mapped double, degree int, loo_rmse double"
    return d.groupBy(*entity, "_m").applyInPandas(run, schema)
