"""Operators whose kernel is numeric: one bounded series per group goes to numpy, everything around it stays columns.

A group is an entity's values of one calendar month, or one entity's series: its size is the length of the record, not of
the table. The kernels of one series are fused, so that it is sent to Python once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xeric.functions import kernels as K

from .series import average_rank


def _by_calendar_month(df: DataFrame, entity: list[str], kernel, value: str, time: str, extra: str) -> DataFrame:
    """Apply (values, times) -> (z, label) within each entity and calendar month."""
    d = df.select(*entity, F.month(time).alias("cal_month"), F.col(time).alias("month"), F.col(value).cast("double").alias("x"))
    kinds = dict(d.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*entity, "cal_month", "month"]) + f", z double, {extra}"
    label = extra.split()[0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, what = kernel(pdf["x"].to_numpy(float), pd.to_datetime(pdf["month"]).dt.year.to_numpy())
        out = pdf[[*entity, "cal_month", "month"]].copy()
        out["z"], out[label] = np.where(np.isfinite(z), z, None), what
        return out

    return d.groupBy(*entity, "cal_month").applyInPandas(run, schema)


def spi(df: DataFrame, entity: list[str], value: str = "k_value", time: str = "month", least: int = 5, positives: int = 10) -> DataFrame:
    """Standardised precipitation of k-month sums; ``method`` 1 gamma, 2 ranks, 3 constant, 0 none."""
    return _by_calendar_month(df, entity, lambda x, y: K.spi(x, None, least, positives), value, time, "method int")


def sspi(df: DataFrame, entity: list[str], first_year: int, last_year: int, value: str = "k_value", time: str = "month", least: int = 15) -> DataFrame:
    """As spi, but fitted on reference years, at least 15 of them, and held to +-5."""
    return _by_calendar_month(df, entity, lambda x, y: K.spi(x, (y >= first_year) & (y <= last_year), least, least, 5.0), value, time, "method int")


def spei(df: DataFrame, entity: list[str], value: str = "k_value", time: str = "month") -> DataFrame:
    """Standardised water balance; ``family`` is the distribution that fitted best."""
    return _by_calendar_month(df, entity, lambda x, y: K.spei(x), value, time, "family string")


def soil_index(df: DataFrame, entity: list[str], kind: str = "beta", value: str = "k_value", time: str = "month") -> DataFrame:
    """Soil moisture by beta moments ("beta") or by a kernel density in logit space ("kernel")."""
    f = {"beta": K.ssi_soil, "kernel": K.ssmi_soil}[kind]
    return _by_calendar_month(df, entity, lambda x, y: (f(x), kind), value, time, "kind string")


def snow_index(df: DataFrame, entity: list[str], value: str = "k_value", time: str = "month", least_share: float = 0.75, cover: str | None = None, least_cover: float = 10.0) -> DataFrame:
    """Snow ranks by calendar month where enough values are above 0; zeros take hashed places below the least of them.

    With ``cover``, a column of the snow-covered share in %, calendar months whose mean is below ``least_cover`` have none.

    The places come from a hash of entity and time, so that a rerun gives the same index.
    """
    w = Window.partitionBy(*entity, F.month(time))
    v = F.col(value)
    low = F.min(F.when(v > 0, v)).over(w)
    share = F.sum((v > 0).cast("double")).over(w) / F.count(v).over(w)
    u = (F.pmod(F.xxhash64(*entity, time), F.lit(1 << 20)) + 0.5) / (1 << 20)
    enough = share >= least_share if cover is None else (share >= least_share) & (F.avg(cover).over(w) >= least_cover)
    d = df.withColumn("cal_month", F.month(time)).withColumn("_v", F.when(enough, F.when(v > 0, v).when(v == 0, u * low)))
    d = average_rank(d, [*entity, "cal_month"], "_v")
    from xeric.functions.labels import normal_quantile

    d = d.withColumn("_n", F.count("_v").over(w)).withColumn("p", (F.col("rank") - 0.44) / (F.col("_n") + 0.12))
    return d.select(*entity, time, "cal_month", "p", normal_quantile("p").alias("z"))


SERIES_TESTS = "n int, mk_z double, mk_p double, sen double, vc_z double, vc_p double, vc_flag boolean, pw_z double, pw_p double, pw_flag boolean, first_change int, n_changes int, n_peaks int, top_period double"


def series_tests(df: DataFrame, entity: list[str], value: str = "value", time: str = "month", least: int = 12, most_ties: float = 0.5) -> DataFrame:
    """All tests of one series in one pass: Mann-Kendall plain, variance-corrected and pre-whitened, changes, peaks.

    Series of under ``least`` values, or with over half of them tied, have nulls.
    """
    d = df.select(*entity, F.col(time).alias("t"), F.col(value).cast("double").alias("x"))
    kinds = dict(d.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in entity) + ", " + SERIES_TESTS
    names = [x.split()[0] for x in SERIES_TESTS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["x"].to_numpy(float)
        x = x[np.isfinite(x)]
        row: dict = dict.fromkeys(names) | {"n": len(x)}
        if len(x) >= least and 1 - len(np.unique(x)) / len(x) <= most_ties:
            _, _, z = K.mann_kendall(x)
            vc_z, vc_p, vc_flag = K.corrected_mk(x)
            pw_z, pw_p, _, pw_flag = K.prewhitened_mk(x)
            changes = K.pelt_mean(x) if len(x) >= 20 else []
            peaks = K.spectral_peaks(x) if len(x) >= 48 else []
            row |= {"mk_z": z, "mk_p": K.two_sided(z), "sen": K.sen_slope(x), "vc_z": vc_z, "vc_p": vc_p, "vc_flag": vc_flag, "pw_z": pw_z, "pw_p": pw_p, "pw_flag": pw_flag}
            row |= {"first_change": changes[0] if changes else None, "n_changes": len(changes), "n_peaks": len(peaks), "top_period": max(peaks, key=lambda p: p[1])[0] if peaks else None}
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in entity}, **row}]).astype({c: "Int32" for c in ("n", "first_change", "n_changes", "n_peaks")})

    return d.groupBy(*entity).applyInPandas(run, schema)


def fill_gaps(df: DataFrame, entity: list[str], longest: int = 14, value: str = "value", time: str = "date") -> DataFrame:
    """Fill inner gaps of a daily series of up to ``longest`` days by a monotone cubic; ends are never filled."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*entity, time]) + f", {value} double, filled boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        days = pd.to_datetime(pdf[time])
        x = pdf[value].to_numpy(float)
        y = K.monotone_fill((days - days.iloc[0]).dt.days.to_numpy(), x, longest)
        out = pdf[[*entity, time]].copy()
        out[value], out["filled"] = np.where(np.isfinite(y), y, None), np.isfinite(y) & ~np.isfinite(x)
        return out

    return df.groupBy(*entity).applyInPandas(run, schema)


def joint_fit(df: DataFrame, entity: list[str], u: str, v: str, least: int = 15) -> DataFrame:
    """The copula of two pseudo-observations with the smallest AIC."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in entity) + ", n int, family string, parameter double, aic double, tau double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf[[u, v]].dropna()
        keys = {c: pdf[c].iloc[0] for c in entity}
        if len(d) < least:
            return pd.DataFrame([{**keys, "n": len(d), "family": None, "parameter": None, "aic": None, "tau": None}])
        family, p, aic, tau = K.fit_copula(d[u].to_numpy(), d[v].to_numpy())
        return pd.DataFrame([{**keys, "n": len(d), "family": family, "parameter": p, "aic": aic, "tau": tau}])

    return df.select(*entity, u, v).groupBy(*entity).applyInPandas(run, schema)


def robust_slope(df: DataFrame, entity: list[str], x: str, y: str, time: str = "month") -> DataFrame:
    """Least-squares slope with Newey-West errors, and a block-bootstrap interval of the mean of y."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in entity) + ", slope double, se double, mean_low double, mean_high double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(time)[[x, y]].dropna()
        keys = {c: pdf[c].iloc[0] for c in entity}
        if len(d) < 8 or d[x].nunique() < 2:
            return pd.DataFrame([{**keys, "slope": None, "se": None, "mean_low": None, "mean_high": None}])
        b, se = K.newey_west(d[x].to_numpy(), d[y].to_numpy())
        lo, hi = K.block_bootstrap_mean(d[y].to_numpy())
        return pd.DataFrame([{**keys, "slope": b, "se": se, "mean_low": lo, "mean_high": hi}])

    return df.select(*entity, time, x, y).groupBy(*entity).applyInPandas(run, schema)


def supply_index(components: DataFrame, entity: list[str], weights: dict[str, float], time: str = "month", least: int = 2, cap: float = 4.2) -> DataFrame:
    """Surface supply: weighted mean of the components' normal scores by calendar month, weights renormalised.

    A component's place is rank / (n + 1) among its calendar month's values, 0.5 if it has under two different ones. At
    least two components must be there; the result is held to +-4.2.
    """
    from xeric.functions.labels import clip, normal_quantile

    d = components.withColumn("cal_month", F.month(time))
    for c in weights:
        w = Window.partitionBy(*entity, "cal_month")
        d = average_rank(d, [*entity, "cal_month"], c, f"_r_{c}")
        d = d.withColumn(f"_n_{c}", F.count(c).over(w)).withColumn(f"_s_{c}", F.max(c).over(w) > F.min(c).over(w))
        p = F.when(F.col(f"_s_{c}"), F.col(f"_r_{c}") / (F.col(f"_n_{c}") + 1)).otherwise(0.5)
        d = d.withColumn("_p", F.when(F.col(c).isNotNull(), F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4)))).withColumn(f"z_{c}", normal_quantile("_p"))
    there = [F.when(F.col(f"z_{c}").isNotNull(), F.lit(float(x))).otherwise(0.0) for c, x in weights.items()]
    total = sum(there[1:], there[0])
    count = sum((F.col(f"z_{c}").isNotNull().cast("int") for c in weights), F.lit(0))
    score = sum((F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) * float(x) for c, x in weights.items()), F.lit(0.0))
    return d.select(*entity, time, *[f"z_{c}" for c in weights], clip(F.when(count >= least, F.try_divide(score, total)), -cap, cap).alias("supply"))


def multi_scale_index(df: DataFrame, entity: list[str], scales: list[str], time: str = "month") -> DataFrame:
    """First principal component of an entity's indices at several scales, standardised; its weights' sum is positive."""
    d = df.select(*entity, F.col(time).alias("month"), *[F.col(c).cast("double").alias(c) for c in scales])
    kinds = dict(d.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*entity, "month"]) + ", score double, share double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month").reset_index(drop=True)
        x = pdf[scales].to_numpy(float)
        ok = np.isfinite(x).all(1)
        out = pdf[[*entity, "month"]].copy()
        out["score"], out["share"] = None, None
        if ok.sum() > len(scales) + 1:
            scores, _, share = K.principal_components(x[ok], np.ones(len(scales)), 1)
            s = scores[:, 0]
            out.loc[ok, "score"], out["share"] = (s - s.mean()) / s.std(ddof=1), float(share[0])
        return out.astype({"score": float, "share": float})

    return d.groupBy(*entity).applyInPandas(run, schema)


def marginal_fit(df: DataFrame, entity: list[str], value: str, least: int = 10) -> DataFrame:
    """The margin of smallest AIC among exponential, gamma, Weibull, log-normal, normal, logistic and, within (0, 1), beta."""
    d = df.select(*entity, F.col(value).cast("double").alias("x"))
    kinds = dict(d.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in entity) + ", n int, family string, p1 double, p2 double, aic double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].dropna().to_numpy(float)
        row = {**{c: pdf[c].iloc[0] for c in entity}, "n": len(x), "family": None, "p1": None, "p2": None, "aic": None}
        if len(x) >= least and x.std() > 0:
            family, p, aic = K.best_margin(x)
            row |= {"family": family, "p1": p[0], "p2": p[1], "aic": aic}
        return pd.DataFrame([row]).astype({"p1": float, "p2": float, "aic": float})

    return d.groupBy(*entity).applyInPandas(run, schema)


def discordancy(sites: DataFrame, region: list[str], site: str) -> DataFrame:
    """Hosking and Wallis's D of each site's (L-CV, t3, t4) in its region; regions of under 5 sites have nulls."""
    d = sites.select(*region, site, F.try_divide("l2", "l1").alias("t"), "t3", "t4")
    kinds = dict(d.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*region, site]) + ", d double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*region, site]].copy()
        out["d"] = np.nan
        u = pdf[["t", "t3", "t4"]].to_numpy(float)
        ok = np.isfinite(u).all(1)
        if ok.sum() >= 5:
            c = u[ok] - u[ok].mean(0)
            s = c.T @ c
            if np.linalg.matrix_rank(s) == 3:
                out.loc[ok, "d"] = ok.sum() / 3 * np.einsum("ij,jk,ik->i", c, np.linalg.inv(s), c)
        return out

    return d.groupBy(*region).applyInPandas(run, schema)
