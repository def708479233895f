"""Lagged association, composites, skill and decomposition in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lagged_correlation(a: DataFrame, b: DataFrame, entity: list[str], lags: int = 12, least: int = 20, time: str = "month", x: str = "x", y: str = "y") -> DataFrame:
    """Pearson correlation of y with x ``lag`` months before, for lags 0..lags; one join, lags exploded on b's side."""
    shifted = b.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn(time, F.add_months(time, F.col("lag")))
    g = a.join(shifted, [*entity, time] if set(entity) <= set(b.columns) else [time]).groupBy(*entity, "lag").agg(F.corr(y, x).alias("r"), F.count("*").alias("n"))
    return g.filter(F.col("n") >= least)


def best_lag(corr: DataFrame, entity: list[str]) -> DataFrame:
    """The lag of the largest |r|; the smaller lag of equals."""
    return corr.groupBy(*entity).agg(F.max_by(F.struct("lag", "r", "n"), F.struct(F.round(F.abs("r"), 9), -F.col("lag"))).alias("b")).select(*entity, "b.*")


def effective_correlation(df: DataFrame, entity: list[str], x: str = "x", y: str = "y", time: str = "month") -> DataFrame:
    """r with the effective sample size max(3, round(n (1 - r1) / (1 + r1))), r1 the mean lag-1 autocorrelation."""
    w = Window.partitionBy(*entity).orderBy(time)
    d = df.withColumns({"_x": F.lag(x).over(w), "_y": F.lag(y).over(w)})
    g = d.groupBy(*entity).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"), ((F.corr(x, "_x") + F.corr(y, "_y")) / 2).alias("r1"))
    n = F.greatest(F.lit(3.0), F.bround(F.try_divide(F.col("n") * (1 - F.col("r1")), 1 + F.col("r1"))))
    return g.withColumn("n_eff", n).withColumn("t", F.col("r") * F.sqrt(F.try_divide(n - 2, F.round(1 - F.col("r") * F.col("r"), 12))))


def leave_year_out(df: DataFrame, entity: list[str], x: str = "x", y: str = "y", time: str = "month", dry: float = -1.282) -> DataFrame:
    """Skill of a line fitted without each year: r, RMSE, hit and false-alarm rates below ``dry``.

    The sums of a fit without a year are the sums of all years less those of that year: no fit is repeated.
    """
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_y", F.year(time))
    a, b = F.col(x), F.col(y)
    sums = {"n": F.lit(1.0), "sx": a, "sy": b, "sxx": a * a, "sxy": a * b}
    part = d.groupBy(*entity, "_y").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    w = Window.partitionBy(*entity)
    rest = part.select(*entity, "_y", *[(F.sum(k).over(w) - F.col(k)).alias(k) for k in sums])
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    rest = rest.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    p = d.join(rest.select(*entity, "_y", "slope", "intercept"), [*entity, "_y"]).withColumn("fit", F.col("intercept") + F.col("slope") * a)
    seen, said = b < dry, F.col("fit") < dry
    count = lambda c: F.sum(c.cast("double"))
    return p.groupBy(*entity).agg(
        F.count("*").alias("n"), F.corr("fit", y).alias("r"), F.sqrt(F.avg((F.col("fit") - b) * (F.col("fit") - b))).alias("rmse"),
        F.try_divide(count(seen & said), count(seen)).alias("hit_rate"), F.try_divide(count(~seen & said), count(said)).alias("false_alarms"),
    )


def composite(df: DataFrame, keys: list[str], event: str, value: str) -> DataFrame:
    """Mean in event months against the others, with Welch's t."""
    on, off = F.when(F.col(event), F.col(value)), F.when(~F.col(event), F.col(value))
    g = df.groupBy(*keys).agg(F.avg(on).alias("event_mean"), F.avg(off).alias("other_mean"), F.count(on).alias("n_event"), F.count(off).alias("n_other"), F.var_samp(on).alias("v1"), F.var_samp(off).alias("v0"))
    se = F.sqrt(F.col("v1") / F.col("n_event") + F.col("v0") / F.col("n_other"))
    return g.select(*keys, "n_event", "event_mean", "other_mean", F.try_divide(F.col("event_mean") - F.col("other_mean"), se).alias("t"))


def lagged_composite(events: DataFrame, series: DataFrame, keys: list[str], event: str, value: str, lags: int = 3, time: str = "month") -> DataFrame:
    """The composite of the series at event times and 0..lags months before them, as ``lag``; one join for all lags."""
    before = events.select(time, event).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn(time, F.add_months(time, -F.col("lag")))
    return composite(series.join(before, time), [*keys, "lag"], event, value)


def decomposition(df: DataFrame, full: str, thermal: str, gate: float = -0.5) -> DataFrame:
    """Dynamic part and, in months at or below the gate, the parts' shares."""
    dry = F.col(full) <= gate
    d = df.withColumn("dynamic", F.col(full) - F.col(thermal))
    return d.withColumns({"thm_frac": F.when(dry, F.try_divide(F.col(thermal), F.col(full))), "dyn_frac": F.when(dry, F.try_divide(F.col("dynamic"), F.col(full)))})


def mediation(df: DataFrame, entity: list[str], x: str, m: str, y: str) -> DataFrame:
    """Indirect (a b), direct and total effect of x on y through m, by the normal equations of two regressions."""
    cov = lambda u, v: F.covar_samp(u, v)
    g = df.filter(F.col(x).isNotNull() & F.col(m).isNotNull() & F.col(y).isNotNull()).groupBy(*entity).agg(cov(x, x).alias("xx"), cov(x, m).alias("xm"), cov(m, m).alias("mm"), cov(x, y).alias("xy"), cov(m, y).alias("my"))
    det = F.col("xx") * F.col("mm") - F.col("xm") * F.col("xm")
    b = F.try_divide(F.col("my") * F.col("xx") - F.col("xy") * F.col("xm"), det)
    direct = F.try_divide(F.col("xy") * F.col("mm") - F.col("my") * F.col("xm"), det)
    a = F.try_divide(F.col("xm"), F.col("xx"))
    total = F.try_divide(F.col("xy"), F.col("xx"))
    return g.select(*entity, a.alias("a"), b.alias("b"), (a * b).alias("indirect"), direct.alias("direct"), total.alias("total"), F.try_divide(a * b, total).alias("mediated"))
