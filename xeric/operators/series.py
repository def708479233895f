"""Operators on monthly and daily series, one row per entity and time step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xeric.functions.labels import water_year


def by_time(entity: list[str], time: str = "month"):
    return Window.partitionBy(*entity).orderBy(time)


def calendar_spine(df: DataFrame, entity: list[str], time: str = "month", step: str = "INTERVAL 1 MONTH") -> DataFrame:
    """Every time step between each entity's first and last one; values that were not there are null.

    One aggregate per entity, one exploded range, one join on the entity and time.
    """
    span = df.groupBy(*entity).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    spine = span.select(*entity, F.explode(F.sequence("_a", "_b", F.expr(step))).alias(time))
    return spine.join(df, [*entity, time], "left")


def trailing(df: DataFrame, entity: list[str], k: int, how: str = "sum", value: str = "value", time: str = "month", out: str = "k_value") -> DataFrame:
    """Sum or mean of the last k rows; null unless all k are there and not null."""
    w = by_time(entity, time).rowsBetween(-(k - 1), 0)
    agg = {"sum": F.sum, "mean": F.avg}[how]
    return df.withColumn(out, F.when(F.count(value).over(w) == k, agg(value).over(w)))


def centred(df: DataFrame, entity: list[str], half: int, how: str = "mean", value: str = "value", time: str = "month", out: str = "c_value") -> DataFrame:
    """Sum or mean of 2 * half + 1 rows around each; null at the ends and beside nulls."""
    w = by_time(entity, time).rowsBetween(-half, half)
    agg = {"sum": F.sum, "mean": F.avg}[how]
    return df.withColumn(out, F.when(F.count(value).over(w) == 2 * half + 1, agg(value).over(w)))


def average_rank(df: DataFrame, groups: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rank from 1 with ties sharing their mean; null values get null and are not ranked."""
    order = Window.partitionBy(*groups).orderBy(F.col(value).asc_nulls_last())
    ties = Window.partitionBy(*groups, value)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.rank().over(order) + (F.count(value).over(ties) - 1) / 2))


def climatology(df: DataFrame, entity: list[str], value: str = "value", time: str = "month") -> DataFrame:
    return df.groupBy(*entity, F.month(time).alias("cal_month")).agg(F.avg(value).alias("clim_mean"), F.max(value).alias("clim_max"), F.min(value).alias("clim_min"))


def anomaly(df: DataFrame, entity: list[str], first_year: int | None = None, last_year: int | None = None, value: str = "value", time: str = "month") -> DataFrame:
    """Departure from the calendar month's mean over the reference years (all years if none are named)."""
    w = Window.partitionBy(*entity, F.month(time))
    inside = F.lit(True) if first_year is None else F.year(time).between(first_year, last_year)
    reference = F.avg(F.when(inside, F.col(value))).over(w)
    return df.withColumn("reference", reference).withColumn("anomaly", F.col(value) - reference)


def detrend_by_month(df: DataFrame, entity: list[str], value: str = "value", time: str = "month", cap: str | None = None) -> DataFrame:
    """Subtract each calendar month's linear trend over the years, keeping the mean; not above the ``cap`` column."""
    y = F.year(time).cast("double")
    fit = df.groupBy(*entity, F.month(time).alias("cal_month")).agg(F.regr_slope(value, y).alias("slope"), F.avg(F.when(F.col(value).isNotNull(), y)).alias("mean_year"))
    j = df.withColumn("cal_month", F.month(time)).join(fit, [*entity, "cal_month"])
    out = F.col(value) - F.coalesce("slope", F.lit(0.0)) * (y - F.col("mean_year"))
    return j.withColumn("detrended", out if cap is None else F.least(out, F.col(cap)))


def annual(df: DataFrame, entity: list[str], how: str = "sum", least: int = 6, months: tuple[int, ...] | None = None, value: str = "value", time: str = "month") -> DataFrame:
    """Yearly sum or mean over all or the named months; null if fewer than ``least`` values."""
    rows = df if months is None else df.filter(F.month(time).isin(*months))
    agg = {"sum": F.sum, "mean": F.avg}[how](value)
    n = F.count(value)
    return rows.groupBy(*entity, F.year(time).alias("year")).agg(n.cast("long").alias("n_months"), F.when(n >= least, agg).alias("annual"))


def daily_to_monthly(df: DataFrame, entity: list[str], how: str = "mean", least_days: int | None = None, least_share: float | None = None, value: str = "value", time: str = "date") -> DataFrame:
    """Monthly mean or total of daily values, null under a number of days or a share of the month's days."""
    m = F.trunc(time, "MM")
    agg = {"sum": F.sum, "mean": F.avg}[how](value)
    n = F.count(value)
    days = F.dayofmonth(F.last_day(F.max(time)))
    ok = n >= least_days if least_days is not None else n >= (least_share or 0.0) * days
    return df.groupBy(*entity, m.alias("month")).agg(n.cast("long").alias("n_days"), F.when(ok, agg).alias("monthly"))


def completeness(df: DataFrame, entity: list[str], value: str = "value", time: str = "date", gap_days: int = 14) -> DataFrame:
    """Share of the days from the first to the last month that hold a value, and gaps of over ``gap_days``."""
    seen = df.filter(F.col(value).isNotNull())
    before = F.lag(time).over(by_time(entity, time))
    rows = seen.withColumn("_gap", F.datediff(time, before) - 1)
    span = F.datediff(F.last_day(F.max(time)), F.trunc(F.min(time), "MM")) + 1
    return rows.groupBy(*entity).agg(
        F.count("*").alias("n_days"), span.cast("long").alias("span_days"), (100.0 * F.count("*") / span).alias("pct_complete"),
        F.sum((F.coalesce("_gap", F.lit(0)) > gap_days).cast("long")).alias("n_gaps"), F.max(F.coalesce("_gap", F.lit(0))).cast("long").alias("longest_gap"),
    )


def first_covered_year(years: DataFrame, entity: list[str], run: int = 5) -> DataFrame:
    """First year of ``run`` consecutive years that are all ok; years is (entity, year, ok) with every year there."""
    w = Window.partitionBy(*entity).orderBy("year").rowsBetween(0, run - 1)
    full = (F.min(F.col("ok").cast("int")).over(w) == 1) & (F.count("*").over(w) == run)
    return years.withColumn("_full", full).groupBy(*entity).agg(F.min(F.when(F.col("_full"), F.col("year"))).alias("first_year"), F.sum(F.col("ok").cast("long")).alias("n_ok"))


def water_year_to_date(df: DataFrame, entity: list[str], value: str = "value", time: str = "month") -> DataFrame:
    w = Window.partitionBy(*entity, water_year(F.col(time))).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("water_year", water_year(F.col(time))).withColumn("to_date", F.sum(value).over(w))


def run_ids(df: DataFrame, entity: list[str], flag: Column, time: str = "month") -> DataFrame:
    """Number the runs of equal flags in each entity (gaps and islands)."""
    w = by_time(entity, time)
    d = df.withColumn("_flag", flag)
    change = F.coalesce((~F.lag("_flag").over(w).eqNullSafe(F.col("_flag"))).cast("int"), F.lit(1))
    d = d.withColumn("_change", F.when(F.row_number().over(w) == 1, 1).otherwise(change))
    return d.withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumnRenamed("_flag", "flag").drop("_change")


def priority_dedup(df: DataFrame, key: list[str], rank: str, tie: list[str]) -> DataFrame:
    """One row per key: that of the best (lowest) source rank, then of the smallest tie columns."""
    w = Window.partitionBy(*key).orderBy(rank, *tie)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def detrend_pair(df: DataFrame, entity: list[str], value: str, capped: str, time: str = "month", least: int = 10) -> DataFrame:
    """Adds ``<value>_detrended`` and ``<capped>_detrended``, the second not above the first (a dew point under its temperature).

    Each has its own slope over the years of a calendar month; both come from one aggregate. Months with under ``least``
    years of both values are left as they are, with nulls. A null value stays null and caps nothing.
    """
    y = F.year(time).cast("double")
    both = F.col(value).isNotNull() & F.col(capped).isNotNull()
    columns = [value, capped]
    sums = [x for c in columns for x in (F.regr_slope(c, y).alias(f"_b_{c}"), F.avg(F.when(F.col(c).isNotNull(), y)).alias(f"_y_{c}"))]
    fit = df.groupBy(*entity, F.month(time).alias("_cal")).agg(*sums, F.count(F.when(both, 1)).alias("_years"))
    j = df.withColumn("_cal", F.month(time)).join(fit, [*entity, "_cal"])
    free = [F.when(F.col("_years") >= least, F.col(c) - F.coalesce(f"_b_{c}", F.lit(0.0)) * (y - F.col(f"_y_{c}"))) for c in columns]
    return j.withColumns({f"{value}_detrended": free[0], f"{capped}_detrended": F.when(free[1].isNotNull(), F.least(free[0], free[1]))}).drop("_cal", "_years", *[f"_{k}_{c}" for k in "by" for c in columns])
