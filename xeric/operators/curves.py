"""Severity by return period and area share from Kendall's distribution, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xeric.functions.special import gamma_upper, log_gamma

from .events import detect_events

#: Halvings of the interval in which Kendall's distribution reaches its target.
HALVINGS = 60


def renewal_target(years: Column, gap: Column, cv: Column) -> Column:
    """Share of months below the event of ``years``; ``gap`` is the mean number of months between events, ``cv`` its variation.

    Events count as Poisson for a ``cv`` of 0.5 to 1.5, unknown or 0, else as a gamma renewal.
    """
    shape = F.try_divide(F.lit(1.0), cv * cv)
    within = 1 - gamma_upper(shape, shape / (gap / 12) * years)
    renewal = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), 1 - within / years / 12))
    return F.when(cv.isNull() | F.isnan(cv) | (cv <= 0) | cv.between(0.5, 1.5), 1 - gap / (years * 12)).otherwise(renewal)


def kendall_level(target: Column, theta: Column) -> Column:
    """The t at which the Gumbel copula's Kendall distribution t - t ln(t) / theta reaches the target, by halvings."""

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        below = mid - mid * F.log(mid) / theta < target
        return F.struct(F.when(below, mid).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(mid).alias("high"))

    start = F.struct(F.lit(1e-8).alias("low"), F.lit(1 - 1e-8).alias("high"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve)
    return (end["low"] + end["high"]) / 2


def kendall_curves(months: DataFrame, entity: list[str], index: str = "z", area: str = "area", onset: float = -0.5, time: str = "month", years: tuple = (10, 25, 50, 100), areas: tuple = tuple(range(5, 100, 5)), least: int = 10) -> DataFrame:
    """``entity, years, area_pct, tau, severity``: the severity on the level curve of each return period at each area share.

    ``months`` holds an index and an area share in percent. Months with an index below 0 and a positive area count; their
    severity is the index's size. Severity has a Weibull margin by L-moments, area its empirical one, and a Gumbel copula
    joins them, its parameter from Kendall's tau (ties count as neither). The severity is null where the area's margin
    alone lies below the level, so that none reaches it. Entities with under ``least`` such months, without two events,
    without spread or with a tau of 0 or less give no rows.

    An entity's record is bounded, so tau is counted over the array of its pairs; return periods and areas are exploded
    last, as constants.
    """
    events = detect_events(months, entity, onset, value=index, time=time)
    gap = F.months_between("start", F.lag("start").over(Window.partitionBy(*entity).orderBy("start")))
    gaps = events.withColumn("_g", gap).groupBy(*entity).agg(F.avg("_g").alias("gap"), F.stddev_samp("_g").alias("_sd"))
    s, a = (-F.col(index)).cast("double"), F.col(area).cast("double")
    active = months.filter((s > 0) & (a > 0)).select(*entity, s.alias("_s"), a.alias("_a"))
    place = F.row_number().over(Window.partitionBy(*entity).orderBy("_s")) - 1
    counts = F.array(*[F.count(F.when(F.col("_a") <= x, 1)) for x in areas])
    g = active.withColumn("_i", place).groupBy(*entity).agg(
        F.count("*").cast("double").alias("n"), F.avg("_s").alias("l1"), F.sum(F.col("_i") * F.col("_s")).alias("b1"), counts.alias("below"),
        F.sort_array(F.collect_list(F.struct("_s", "_a"))).alias("pairs"),
    )
    n = F.col("n")
    # From the i-th on in order of severity, later places with more area less those with less.
    later = lambda x, i: F.slice("pairs", i + 2, F.size("pairs"))
    score = lambda x, y: F.when(y["_s"] > x["_s"], F.signum(y["_a"] - x["_a"])).otherwise(0.0)
    row = lambda x, i: F.aggregate(later(x, i), F.lit(0.0), lambda t, y: t + score(x, y))
    agreed = F.aggregate(F.transform("pairs", row), F.lit(0.0), lambda t, v: t + v)
    g = g.withColumn("tau", F.try_divide(agreed, n * (n - 1) / 2)).withColumn("l2", F.try_divide(2 * F.col("b1"), n * (n - 1)) - F.col("l1")).drop("pairs")
    g = g.filter((n >= least) & (F.col("tau") > 0) & (F.col("tau") < 1) & (F.col("l2") > 0) & (F.col("l2") < F.col("l1")))
    shape = -F.try_divide(F.log(F.lit(2.0)), F.log(1 - F.try_divide("l2", "l1")))
    g = g.withColumn("shape", shape).withColumn("scale", F.col("l1") / F.exp(log_gamma(1 + 1 / F.col("shape")))).withColumn("theta", F.try_divide(F.lit(1.0), 1 - F.col("tau")))
    g = g.join(gaps.filter("gap > 0"), entity).withColumn("years", F.explode(F.array(*[F.lit(float(y)) for y in years])))
    g = g.withColumn("target", renewal_target(F.col("years"), F.col("gap"), F.try_divide("_sd", "gap"))).filter("target > 0 and target < 1")
    g = g.withColumn("level", kendall_level(F.col("target"), F.col("theta")))
    points = F.arrays_zip(F.array(*[F.lit(float(x)) for x in areas]).alias("area_pct"), F.col("below").alias("c"))
    g = g.withColumn("p", F.explode(points))
    v = F.greatest(0.5 / (n + 1), F.least(n / (n + 1), F.col("p.c") / (n + 1)))
    left = F.pow(-F.log("level"), F.col("theta")) - F.pow(-F.log(v), F.col("theta"))
    u = F.exp(-F.pow(left, 1 / F.col("theta")))
    severity = F.when((left > 0) & (u < 1), F.col("scale") * F.pow(-F.log(1 - u), 1 / F.col("shape")))
    return g.select(*entity, "years", F.col("p.area_pct").alias("area_pct"), "tau", severity.alias("severity"))
