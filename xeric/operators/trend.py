"""Trends, change points and runs in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xeric.functions.special import solve


def pair_slopes(df: DataFrame, entity: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """(entity, slope, sign) of every pair of an entity's rows, from one sorted array per entity.

    Pairs are made where the series is: a join of the series with itself would move each series once more.
    """
    s = df.filter(F.col(v).isNotNull()).groupBy(*entity).agg(F.sort_array(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v")))).alias("s"))
    first = s.select(*entity, "s", F.posexplode("s").alias("i", "a"))
    later = first.select(*entity, "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    slope = F.try_divide(F.col("b.v") - F.col("a.v"), F.col("b.t") - F.col("a.t"))
    return later.select(*entity, slope.alias("slope"), F.signum(F.col("b.v") - F.col("a.v")).alias("sign"))


def mann_kendall(df: DataFrame, entity: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """Kendall's S with its variance for ties, tau, z without continuity correction, and Sen's slope."""
    pairs = pair_slopes(df, entity, t, v).groupBy(*entity).agg(F.sum("sign").alias("s"), F.percentile("slope", F.lit(0.5)).alias("sen"))
    ties = df.filter(F.col(v).isNotNull()).groupBy(*entity, v).agg(F.count("*").cast("double").alias("c")).groupBy(*entity)
    c = F.col("c")
    n = ties.agg(F.sum("c").alias("n"), F.sum(c * (c - 1) * (2 * c + 5)).alias("tied"))
    d = pairs.join(n, entity)
    m = F.col("n")
    variance = (m * (m - 1) * (2 * m + 5) - F.col("tied")) / 18
    return d.select(*entity, m.cast("long").alias("n"), "s", (F.col("s") / (m * (m - 1) / 2)).alias("tau"), variance.alias("variance"), F.when(variance > 0, F.col("s") / F.sqrt(variance)).alias("z"), "sen")


def runs_test(df: DataFrame, entity: list[str], flag: str = "flag", time: str = "month") -> DataFrame:
    """Wald-Wolfowitz runs of a 0/1 flag: expected runs, z, and whether events cluster or disperse (|z| > 1.96)."""
    w = Window.partitionBy(*entity).orderBy(time)
    d = df.withColumn("_new", F.when(F.lag(flag).over(w) == F.col(flag), 0).otherwise(1))
    g = d.groupBy(*entity).agg(F.sum(F.col(flag).cast("double")).alias("n1"), F.sum(1.0 - F.col(flag)).alias("n0"), F.sum("_new").cast("double").alias("runs"))
    n0, n1 = F.col("n0"), F.col("n1")
    n = n0 + n1
    mean = 2 * n0 * n1 / n + 1
    variance = F.try_divide(2 * n0 * n1 * (2 * n0 * n1 - n), n * n * (n - 1))
    z = F.when(variance > 0, (F.col("runs") - mean) / F.sqrt(variance))
    kind = F.when(z < -1.96, "clustered").when(z > 1.96, "dispersed").when(z.isNotNull(), "random")
    return g.select(*entity, "n0", "n1", "runs", mean.alias("expected"), z.alias("z"), kind.alias("kind"))


def pettitt(df: DataFrame, entity: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """Pettitt's change point from ranks: U_t = 2 * (sum of the first t ranks) - t (n + 1); K and its approximate p."""
    w = Window.partitionBy(*entity)
    rank = F.rank().over(w.orderBy(v)) + (F.count("*").over(Window.partitionBy(*entity, v)) - 1) / 2
    d = df.filter(F.col(v).isNotNull()).withColumn("_rank", rank)
    up = w.orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_n": F.count("*").over(w), "_i": F.count("*").over(up), "_sum": F.sum("_rank").over(up)})
    d = d.withColumn("_u", 2 * F.col("_sum") - F.col("_i") * (F.col("_n") + 1))
    best = F.max_by(F.struct(F.col(t).alias("t"), F.col("_u").alias("u")), F.struct(F.abs("_u"), -F.col("_i")))
    g = d.groupBy(*entity).agg(best.alias("b"), F.first("_n").cast("double").alias("n"))
    k = F.abs("b.u")
    p = F.least(F.lit(1.0), 2 * F.exp(-6 * k * k / (F.pow("n", F.lit(3)) + F.pow("n", F.lit(2)))))
    return g.select(*entity, F.col("b.t").alias("change_at"), k.alias("k"), p.alias("p"))


def linear_trend(df: DataFrame, entity: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope with its standard error and R squared."""
    g = df.groupBy(*entity).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_count(y, x).alias("n"))
    rss = F.col("syy") * (1 - F.col("r2"))
    return g.select(*entity, "n", "slope", "intercept", "r2", F.when(F.col("n") > 2, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(rss, (F.col("n") - 2) * F.col("sxx"))))).alias("slope_se"))


def chow(df: DataFrame, entity: list[str], x: str, y: str, split) -> DataFrame:
    """Chow's F for one line against two, split by a condition."""
    rss = F.regr_syy(y, x) * (1 - F.coalesce(F.regr_r2(y, x), F.lit(0.0)))
    part = df.groupBy(*entity, split.alias("_side")).agg(rss.alias("rss"), F.regr_count(y, x).alias("n"))
    two = part.groupBy(*entity).agg(F.sum("rss").alias("two"), F.sum("n").alias("n"), F.count("*").alias("sides"))
    one = df.groupBy(*entity).agg(rss.alias("one"))
    f = F.try_divide((F.col("one") - F.col("two")) / 2, F.col("two") / (F.col("n") - 4))
    return one.join(two, entity).filter("sides = 2").select(*entity, "n", f.alias("f"))


def ols_cusum(df: DataFrame, entity: list[str], y: str, predictors: list[str], time: str = "month", least: int = 10) -> DataFrame:
    """``entity, n, statistic, p, change_at``: whether a regression's coefficients stay the same, by its summed residuals.

    The statistic is the largest absolute running sum of the residuals over sigma sqrt(n), sigma with n - k - 1 degrees of
    freedom for k predictors; p is that of a Brownian bridge. ``change_at`` is the earliest time of the largest sum. Rows with
    a null in any column are left out. Entities of under ``least`` rows, or fewer than k + 2, give no row, and those with
    predictors that depend on each other or without residuals nulls. Sums, residuals and running sums share one shuffle on the entity.
    """
    w = Window.partitionBy(*entity)
    k = len(predictors)
    d = df.dropna(subset=[*entity, y, *predictors]).select(*entity, time, *[F.col(c).cast("double").alias(c) for c in (y, *predictors)])
    rows = [F.array(*[F.covar_pop(a, b).over(w) for b in (*predictors, y)]) for a in predictors]
    d = d.withColumns({"_system": F.array(*rows), "_n": F.count("*").over(w), **{f"_m_{c}": F.avg(c).over(w) for c in (y, *predictors)}})
    d = d.withColumn("_b", solve(F.col("_system"), k))
    e = F.col(y) - F.col(f"_m_{y}")
    for i, c in enumerate(predictors):
        e = e - F.col("_b")[i] * (F.col(c) - F.col(f"_m_{c}"))
    d = d.withColumn("_e", e).withColumn("_run", F.abs(F.sum("_e").over(w.orderBy(time).rowsBetween(Window.unboundedPreceding, 0))))
    largest = F.max_by(F.struct(F.col("_run").alias("run"), F.col(time).alias("at")), F.struct("_run", -F.unix_date(F.col(time).cast("date"))))
    g = d.groupBy(*entity).agg(F.count("*").alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("rss"), largest.alias("l"), F.sum(F.col(y) * F.col(y)).alias("size")).filter((F.col("n") >= least) & (F.col("n") >= k + 2))
    x = F.when(F.col("rss") > 1e-20 * F.col("size"), F.col("l.run") / F.sqrt(F.col("rss") / (F.col("n") - k - 1) * F.col("n")))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.when(i % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * i * i * x * x))
    p = F.when(x < 0.2, 1.0).when(x >= 0.2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))))
    return g.select(*entity, "n", x.alias("statistic"), p.alias("p"), F.when(x.isNotNull(), F.col("l.at")).alias("change_at"))
