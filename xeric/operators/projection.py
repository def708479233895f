"""Projection of a fitted event model over years from a table of posterior draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xeric.functions.special import gamma_upper

#: Years that each draw is expanded by.
MOST_YEARS = 2000
BANDS = (0.025, 0.25, 0.5, 0.75, 0.975)


def annual_exceedance(draws: DataFrame, years: DataFrame, target: float, events_a_year: float) -> DataFrame:
    """draws (..., alpha, beta, phi) by years (year, covariate), with p_annual, the chance that a year exceeds the target.

    Severities are gamma with shape phi and mean exp(alpha + beta * covariate); events are a Poisson process, so a year's
    chance is 1 - (1 - p)^events. Each draw is expanded by the years, a list of 2000 at most; longer ones are refused, as
    a projection is by years. Draws with a null parameter, or a phi that is not above 0, have a null chance.
    """
    listed = years.select(F.col("year").cast("int"), F.col("covariate").cast("double")).limit(MOST_YEARS + 1).collect()
    if len(listed) > MOST_YEARS:
        raise ValueError(f"over {MOST_YEARS} years to project")
    each = F.array(*[F.struct(F.lit(r[0]).alias("year"), F.lit(r[1]).cast("double").alias("covariate")) for r in listed]) if listed else F.lit(None).cast("array<struct<year:int,covariate:double>>")
    d = draws.select("*", F.explode(each).alias("_y")).select(*draws.columns, "_y.*")
    mean = F.exp(F.col("alpha") + F.col("beta") * F.col("covariate"))
    p = gamma_upper(F.col("phi"), F.lit(float(target)) * F.col("phi") / mean)
    return d.withColumn("p_annual", 1 - F.pow(1 - p, F.lit(float(events_a_year))))


def effective_return_period(annual: DataFrame, keys: list[str], bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(keys, year, n, p_.., t_..): quantiles over the draws of a year's chance and of its return period 1 / chance.

    A group is one model's draws of one year, a few thousand; a chance of 0 has no return period and is left out of its
    quantiles.
    """
    t = F.when(F.col("p_annual") > 0, 1 / F.col("p_annual"))
    g = annual.groupBy(*keys, "year").agg(F.count("p_annual").alias("n"), F.percentile("p_annual", list(bands)).alias("p"), F.percentile(t, list(bands)).alias("t"))
    name = lambda stem, q: f"{stem}_{q * 100:g}".replace(".", "_")
    return g.select(*keys, "year", "n", *[F.col(s)[i].alias(name(s, q)) for s in "pt" for i, q in enumerate(bands)])


def expected_exceedances(annual: DataFrame, keys: list[str], draw: str, first: int, last: int, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(keys, n_years, n, ene_.., return_..): quantiles of the exceedances that the draws expect in first..last."""
    here = annual.filter(F.col("year").between(first, last))
    sums = here.groupBy(*keys, draw).agg(F.sum("p_annual").alias("_e"))
    g = sums.groupBy(*keys).agg(F.count("_e").alias("n"), F.percentile("_e", list(bands)).alias("e"))
    n = last - first + 1
    name = lambda stem, q: f"{stem}_{q * 100:g}".replace(".", "_")
    cols = [F.col("e")[i].alias(name("ene", q)) for i, q in enumerate(bands)] + [F.try_divide(F.lit(float(n)), F.col("e")[i]).alias(name("return", q)) for i, q in enumerate(bands)]
    return g.select(*keys, F.lit(n).alias("n_years"), "n", *cols)
