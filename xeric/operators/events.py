"""Drought events: runs of a two-threshold state, under explicit rules for nulls and severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import by_time


def drought_state(df: DataFrame, entity: list[str], onset: float, end: float | None = None, closed_onset: bool = False, value: str = "value", time: str = "month") -> DataFrame:
    """1 in a drought: it begins below ``onset`` and ends at ``end`` or above; between them and at nulls it goes on."""
    v = F.col(value)
    begins = v <= onset if closed_onset else v < onset
    over = v > onset if closed_onset else v >= (onset if end is None else end)
    w = by_time(entity, time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("state", F.coalesce(F.last(F.when(begins, 1).when(over, 0), ignorenulls=True).over(w), F.lit(0)))


def island_rows(df: DataFrame, entity: list[str], flag: Column, time: str = "month") -> DataFrame:
    """Rows whose flag holds, with the number of their run."""
    w = by_time(entity, time)
    d = df.withColumn("_on", F.coalesce(flag.cast("int"), F.lit(0)))
    d = d.withColumn("_begin", ((F.col("_on") == 1) & (F.coalesce(F.lag("_on").over(w), F.lit(0)) == 0)).cast("int"))
    return d.withColumn("event", F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_on = 1").drop("_on", "_begin")


def detect_events(df: DataFrame, entity: list[str], onset: float = -0.5, end: float | None = None, nulls: str = "keep", min_months: int = 1, value: str = "value", time: str = "month", closed_onset: bool = False) -> DataFrame:
    """One row per event, with every severity the users of an event table ask for.

    ``nulls``: "keep" lets a null month stay inside an open event and count; "drop" removes null rows first, so time
    closes up. ``deficit`` is the mean of end - value, ``severity`` that times the duration, ``abs_sum`` the sum of
    absolute values, ``neg_mean`` the mean of the part below zero.
    """
    edge = onset if end is None else end
    rows = df if nulls == "keep" else df.filter(F.col(value).isNotNull())
    rows = drought_state(rows, entity, onset, end, closed_onset, value, time)
    rows = island_rows(rows, entity, F.col("state") == 1, time)
    v = F.col(value)
    n = F.count("*")
    deficit = F.avg(edge - v)
    out = rows.groupBy(*entity, "event").agg(
        F.min(time).alias("start"), F.max(time).alias("finish"), n.alias("duration"), F.min(v).alias("minimum"), F.avg(v).alias("mean_value"), deficit.alias("deficit"),
        (deficit * n).alias("severity"), F.sum(F.abs(v)).alias("abs_sum"), F.avg(F.abs(F.least(v, F.lit(0.0)))).alias("neg_mean"),
    )
    return out.filter(F.col("duration") >= min_months)


def ranked(events: DataFrame, entity: list[str], n_years: Column | None = None, order: str = "severity") -> DataFrame:
    """Rank by severity (ties by start), return period (N + 1) / rank and percentile."""
    w = Window.partitionBy(*entity)
    r = F.row_number().over(w.orderBy(F.col(order).desc(), F.col("start")))
    n = F.count("*").over(w)
    return events.withColumns({"rank": r, "return_period": ((n if n_years is None else n_years) + 1) / r, "percentile": 100.0 * (n - r + 1) / n})


def event_counts(events: DataFrame, entity: list[str]) -> DataFrame:
    d = F.col("duration")
    return events.groupBy(*entity).agg(
        F.count("*").alias("n_events"), F.avg("duration").alias("mean_duration"), F.max("duration").alias("max_duration"), F.avg("severity").alias("mean_severity"), F.max("severity").alias("max_severity"),
        F.sum(d.between(3, 6).cast("long")).alias("d3_6"), F.sum(d.between(7, 12).cast("long")).alias("d7_12"), F.sum((d >= 13).cast("long")).alias("d13_up"), F.sum((d >= 4).cast("long")).alias("d4_up"),
    )


def months_of_events(months: DataFrame, events: DataFrame, entity: list[str], time: str = "month") -> DataFrame:
    """Months inside events: an equi-join on the entity with the interval as its condition."""
    e = events.select(*entity, "event", "start", "finish")
    return months.join(e, entity).filter(F.col(time).between(F.col("start"), F.col("finish")))


def primary_driver(months: DataFrame, events: DataFrame, entity: list[str], drivers: dict[str, str], time: str = "month") -> DataFrame:
    """``entity, event, least_<driver>..., primary_driver``: the driver with the smallest value in each event's months.

    ``drivers`` names the columns of standard scores and what each stands for. Of equal least values the first one named
    counts; an event without any score is "Unknown".
    """
    inside = months_of_events(months, events, entity, time)
    g = inside.groupBy(*entity, "event").agg(*[F.min(F.when(~F.isnan(c), F.col(c))).alias(f"least_{c}") for c in drivers])
    lowest = F.least(*[F.col(f"least_{c}") for c in drivers], F.lit(None).cast("double"))
    label = F.coalesce(*[F.when(F.col(f"least_{c}") == lowest, F.lit(v)) for c, v in drivers.items()], F.lit("Unknown"))
    return g.withColumn("primary_driver", label)
