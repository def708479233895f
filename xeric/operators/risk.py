"""Operators around the kernels of one record: streamflow index, water balance variants, area curves, moving dependence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xeric.functions import kernels as K
from xeric.functions import risk_kernels as R

from .events import detect_events
from .indices import _by_calendar_month, spei
from .placement import rolling_tau
from .frequency import l_moments
from .series import detrend_by_month, trailing


def _per_record(df: DataFrame, entity: list[str], columns: list[str], run, schema: str) -> DataFrame:
    """Apply a kernel to each entity's record, sorted by month; a record's size is its length in months."""
    kinds = dict(df.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in entity)

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        names = [p.split()[0] for p in schema.split(", ")]
        out = pd.DataFrame(list(run(pdf)), columns=names)
        for i, c in enumerate(entity):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    return df.select(*entity, "month", *columns).groupBy(*entity).applyInPandas(apply, f"{head}, {schema}")


def streamflow_index(df: DataFrame, entity: list[str], value: str = "value", time: str = "month", least_years: int = 10, least_months: int = 120) -> DataFrame:
    """Standardised streamflow by the best of six families; entities with under ``least_months`` values have none."""
    enough = df.groupBy(*entity).agg(F.count(value).alias("_n")).filter(F.col("_n") >= least_months).select(*entity)
    return _by_calendar_month(df.join(enough, entity, "left_semi"), entity, lambda x, y: R.streamflow_index(x, least_years), value, time, "family string")


def balance_variants(df: DataFrame, entity: list[str], water: str, demands: dict[str, str], k: int = 3, time: str = "month") -> DataFrame:
    """SPEI of water - demand for every demand as it is and detrended by calendar month, as ``variant``, in one job."""
    variants = []
    for name, c in demands.items():
        held = detrend_by_month(df, entity, c, time).select(*entity, F.col(time), F.col("detrended").alias("_d"))
        variants += [df.select(*entity, time, F.lit(name).alias("variant"), (F.col(water) - F.col(c)).alias("value"))]
        variants += [df.join(held, [*entity, time]).select(*entity, time, F.lit(f"{name}_detrended").alias("variant"), (F.col(water) - F.col("_d")).alias("value"))]
    out = variants[0]
    for v in variants[1:]:
        out = out.unionByName(v)
    return spei(trailing(out, [*entity, "variant"], k), [*entity, "variant"])


def area_frequency_curves(months: DataFrame, entity: list[str], index: str = "z", severity: Column | None = None, area: str = "area", onset: float = -0.5) -> DataFrame:
    """Severity by return period and area share of each entity; ``months`` is (entity, month, index, area %)."""
    events = detect_events(months, entity, onset, value=index)
    from pyspark.sql import Window

    gap = F.months_between("start", F.lag("start").over(Window.partitionBy(*entity).orderBy("start")))
    gaps = events.withColumn("_g", gap).groupBy(*entity).agg(F.avg("_g").alias("gap"), (F.stddev_samp("_g") / F.avg("_g")).alias("cv"))
    s = F.greatest(F.lit(0.0), -F.col(index)) if severity is None else severity
    active = months.withColumn("severity", s).filter((F.col("severity") > 0) & (F.col(area) > 0)).join(gaps.filter("gap > 0"), entity).withColumn("area", F.col(area).cast("double"))

    def run(pdf):
        return R.saf_curves(pdf["severity"].to_numpy(float), pdf["area"].to_numpy(float), float(pdf["gap"].iloc[0]), float(pdf["cv"].fillna(np.nan).iloc[0]))

    return _per_record(active, entity, ["severity", "area", "gap", "cv"], run, "years double, area_pct double, severity double, family string")


def consensus_change(df: DataFrame, entity: list[str], x: str, y: str, half: int = 6) -> DataFrame:
    """Change of the rolling tau between x and y, where two of three tests agree."""
    d = rolling_tau(df, entity, x, y, half).withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})

    def run(pdf):
        n = len(pdf)
        u, v = (K.average_ranks(pdf[c].to_numpy(float)) / (n + 1) for c in ("_x", "_y"))
        yield R.consensus_change(pdf["tau"].to_numpy(float), pd.to_datetime(pdf["month"]).dt.year.to_numpy(), u, v)

    return _per_record(d.dropna(subset=["_x", "_y"]), entity, ["tau", "_x", "_y"], run, "pettitt_year int, pettitt_p double, cusum_year int, cusum_p double, copula_year int, copula_p double, detected boolean, year int")


def noise_envelope(df: DataFrame, entity: list[str], value: str = "value") -> DataFrame:
    """Spectrum of each entity's record beside the envelope of white noise."""
    d = df.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    return _per_record(d, entity, ["_v"], lambda p: R.white_noise_envelope(p["_v"].to_numpy(float)) if len(p) >= 24 else [], "period double, power double, outside boolean")


MEDIATION = ("indirect_low", "indirect_mid", "indirect_high", "direct", "total", "share", "moderation", "mid_low", "mid_high")


def moderated_mediation(df: DataFrame, entity: list[str], x: str, w: str, m: str, y: str) -> DataFrame:
    """Indirect effect of x on y through m, moderated by w, with its bootstrap interval, by entity."""
    d = df.select(*entity, "month", *[F.col(c).cast("double").alias(f"_{k}") for k, c in zip("xwmy", (x, w, m, y), strict=True)]).dropna()

    def run(pdf):
        z = [pdf[c].to_numpy(float) for c in ("_x", "_w", "_m", "_y")]
        got = R.moderated_mediation(*[(v - v.mean()) / (v.std() or 1.0) for v in z])
        if got:
            yield tuple(got[k] for k in MEDIATION)

    return _per_record(d, entity, ["_x", "_w", "_m", "_y"], run, ", ".join(f"{k} double" for k in MEDIATION))


def vine_order(df: DataFrame, entity: list[str], columns: list[str]) -> DataFrame:
    """The columns in the order of a D-vine by Kendall's tau, joined by commas, by entity."""

    def run(pdf):
        v = [pdf[c].to_numpy(float) for c in columns]
        tau = np.array([[K.kendall_tau(a, b) for b in v] for a in v])
        yield (",".join(columns[i] for i in R.vine_order(tau)),)

    return _per_record(df.dropna(subset=columns), entity, columns, run, "vine string")


def kendall_return_period(df: DataFrame, entity: list[str], x: str, y: str, gap: str) -> DataFrame:
    """Kendall return period of each row's pair within its entity; entities of under ten rows have none."""
    d = df.select(*entity, "month", *[F.col(c).cast("double").alias(f"_{k}") for k, c in zip("xyg", (x, y, gap), strict=True)]).dropna()

    def run(pdf):
        if len(pdf) >= 10:
            family, years = R.kendall_return_periods(pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float), float(pdf["_g"].iloc[0]))
            yield from zip(pdf["month"], years.tolist(), [family] * len(pdf), strict=True)

    return _per_record(d, entity, ["_x", "_y", "_g"], run, "month date, years double, family string")


def extreme_return_period(df: DataFrame, entity: list[str], first_year: int, last_year: int, value: str = "value") -> DataFrame:
    """Return period of the focus years' mean by a GEV distribution of the yearly maxima."""
    d = df.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))

    def run(pdf):
        years = pd.to_datetime(pdf["month"]).dt.year
        focus = pdf.loc[years.between(first_year, last_year), "_v"].mean()
        yield float(focus), R.gev_return_period(pdf.groupby(years)["_v"].max().to_numpy(float), float(focus))

    return _per_record(d, entity, ["_v"], run, "focus double, years double")


def region_homogeneity(df: DataFrame, region: list[str], site: str, value: str = "value", least: int = 5) -> DataFrame:
    """H of each region and its pooled L-CV: sites' L-moments are columns; a region's kernel sees two numbers a site."""
    d = l_moments(df.filter(F.col(value) > 0), [*region, site], value).filter(F.col("n") >= least)
    d = d.select(*region, F.col(site).alias("month"), F.col("n").cast("int").alias("_n"), F.try_divide("l2", "l1").alias("_t"))

    def run(pdf):
        n, t = pdf["_n"].to_numpy(int), pdf["_t"].to_numpy(float)
        h = R.heterogeneity(n, t)
        yield len(n), float((n * t).sum() / n.sum()), h if np.isfinite(h) else None, R.shrink_weight(h)

    return _per_record(d, region, ["_n", "_t"], run, "n_sites int, lcv double, h double, weight double")


def regional_index(df: DataFrame, region: list[str], site: str, first_year: int, last_year: int, value: str = "k_value", time: str = "month", least: int = 15) -> DataFrame:
    """Local index drawn towards its region's by how homogeneous the region is, by calendar month.

    The regional fit pools the reference years' values over each site's mean; one shuffle by site and month, and one row
    for each region and month is joined to them.
    """
    d = df.withColumn("cal_month", F.month(time))
    inside = d.filter(F.year(time).between(first_year, last_year) & (F.col(value) > 0))
    pooled = region_homogeneity(inside, [*region, "cal_month"], site, value, min(5, least)).select(*region, "cal_month", "lcv", "weight")
    rows = d.join(pooled, [*region, "cal_month"], "left").select(*region, site, "cal_month", F.col(time).alias("month"), F.col(value).cast("double").alias("x"), "lcv", "weight")
    kinds = dict(rows.dtypes)
    keys = [*region, site, "cal_month"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        year = pd.to_datetime(pdf["month"]).dt.year.to_numpy()
        lcv, weight = (float(pdf[c].fillna(0.0).iloc[0]) for c in ("lcv", "weight"))
        z, method = R.regional_index(pdf["x"].to_numpy(float), (year >= first_year) & (year <= last_year), lcv, weight, least)
        out = pdf[[*keys, "month"]].copy()
        out["z"], out["method"] = np.where(np.isfinite(z), z, None), method
        return out

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "month"]) + ", z double, method int"
    return rows.groupBy(*keys).applyInPandas(run, schema)


def joint_index(df: DataFrame, entity: list[str], columns: list[str]) -> DataFrame:
    """Empirical joint index of several pseudo-observations by entity, and each one's contribution.

    The place is that of the empirical copula's Kendall function, not of a fitted vine.
    """

    def run(pdf):
        base, place, share = R.joint_places(pdf[columns].to_numpy(float))
        yield from zip(pdf["month"], base.tolist(), place.tolist(), *share.T.tolist(), strict=True)

    schema = "month date, copula double, place double, " + ", ".join(f"share_{c} double" for c in columns)
    return _per_record(df.dropna(subset=columns), entity, columns, run, schema)
