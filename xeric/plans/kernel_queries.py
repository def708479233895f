"""Queries whose kernels have no SQL; tests compare them with plain versions and known values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from xeric.operators import frequency as Q
from xeric.operators import indices as I
from xeric.operators.patterns import eof
from xeric.operators.series import calendar_spine, trailing

from .base import daily, index_months, index_values, query, site_months, spined_months

SITE = ["site"]


def _sums(spark, sf):
    return trailing(spined_months(spark, sf), SITE, 3)


@query("spi_gamma")
def spi_gamma(spark, sf):
    """With a gate of 5 positives, as the tables hold 6 or 7 years."""
    return I.spi(_sums(spark, sf), SITE, positives=5)


@query("spei_best_fit")
def spei_best_fit(spark, sf):
    sm = spined_months(spark, sf)
    mean = sm.groupBy("month").agg(F.avg("value").alias("basin"))
    d = sm.join(mean, "month").withColumn("value", F.col("value") - F.col("basin"))
    return I.spei(trailing(d, SITE, 3), SITE)


@query("sspi_reference")
def sspi_reference(spark, sf):
    return I.sspi(_sums(spark, sf), SITE, 1995, 2000, least=5)


def _share(spark, sf):
    d = trailing(spined_months(spark, sf), SITE, 3, "mean")
    return d.withColumn("k_value", F.col("k_value") / (F.col("k_value") + 1000))


@query("ssi_soil_beta")
def ssi_soil_beta(spark, sf):
    return I.soil_index(_share(spark, sf), SITE, "beta")


@query("ssmi_soil_kernel")
def ssmi_soil_kernel(spark, sf):
    return I.soil_index(_share(spark, sf), SITE, "kernel")


@query("swei_snow")
def swei_snow(spark, sf):
    d = _sums(spark, sf).withColumn("k_value", F.when(F.col("k_value").isNotNull(), F.greatest(F.lit(0.0), F.col("k_value") - 1500)))
    return I.snow_index(d, SITE)


@query("series_tests")
def series_tests(spark, sf):
    return I.series_tests(site_months(spark, sf), SITE)


@query("filled_gaps")
def filled_gaps(spark, sf):
    d = daily(spark, sf).filter(F.day("date") % 7 != 3)
    return I.fill_gaps(calendar_spine(d, ["station"], "date", "INTERVAL 1 DAY"), ["station"])


@query("copula_fit")
def copula_fit(spark, sf):
    idx = index_months(spark, sf)
    other = idx.select(((F.col("site") + 24) % 25).alias("site"), "month", F.col("z").alias("x"))
    d = idx.select("site", "month", F.col("z").alias("y")).join(other, ["site", "month"])
    return I.joint_fit(Q.pseudo_observations(d, SITE, ["x", "y"]), SITE, "u_x", "u_y")


@query("robust_slope")
def robust_slope(spark, sf):
    sm = site_months(spark, sf).withColumn("t", F.months_between("month", F.lit("1995-01-01").cast("date")))
    return I.robust_slope(sm, SITE, "t", "value")


@query("eof_scores")
def eof_scores(spark, sf):
    """Scores of the sites' leading patterns, positive in 1997 and 1998."""
    return eof(site_months(spark, sf), "site", "month", "value", focus=F.year("month").between(1997, 1998))[1]


@query("multi_scale_index")
def multi_scale_index(spark, sf):
    d = site_months(spark, sf)
    for k in (1, 2, 3, 6):
        d = trailing(d, SITE, k, out=f"k{k}")
    return I.multi_scale_index(d, SITE, ["k1", "k2", "k3", "k6"])


@query("marginal_fit")
def marginal_fit(spark, sf):
    return I.marginal_fit(site_months(spark, sf), SITE, "value")


@query("discordancy")
def discordancy(spark, sf):
    return I.discordancy(Q.l_moments(site_months(spark, sf), SITE).withColumn("region", F.col("site") % 2), ["region"], "site")


@query("return_period_interval")
def return_period_interval(spark, sf):
    """One row per site: the interval is computed where the counts are, in a vectorised function."""
    from xeric.functions.kernels import poisson_interval
    from xeric.operators.events import detect_events

    idx = index_months(spark, sf)
    e = detect_events(idx, SITE, value="z").groupBy("site").agg(F.count("*").alias("n"))
    years = idx.groupBy("site").agg((F.count("*") / 12).alias("years"))

    @F.pandas_udf("low double, high double")
    def interval(n: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([poisson_interval(int(a), float(b)) for a, b in zip(n, y, strict=True)], columns=["low", "high"])

    d = e.join(years, "site").withColumn("i", interval("n", "years"))
    return d.select("site", "n", (F.col("years") / F.col("n")).alias("return_period"), "i.low", "i.high")
