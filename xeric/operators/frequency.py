"""Return periods, L-moments, dependence and bias statistics in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_return_periods(events: DataFrame, entity: list[str], label: str, n_years: Column) -> DataFrame:
    """Years per event of each class."""
    return events.groupBy(*entity, label).agg(F.count("*").alias("n"), F.try_divide(F.first(n_years).cast("double"), F.count("*")).alias("return_period"))


def renewal(events: DataFrame, entity: list[str], start: str = "start") -> DataFrame:
    """Months between event starts: mean, CV, gamma shape 1 / CV^2, and whether they look Poisson (.5 < CV < 1.5)."""
    w = Window.partitionBy(*entity).orderBy(start)
    d = events.withColumn("iat", F.months_between(start, F.lag(start).over(w)))
    g = d.groupBy(*entity).agg(F.count("iat").alias("n"), F.avg("iat").alias("mean_iat"), F.stddev_samp("iat").alias("sd"))
    cv = F.try_divide(F.col("sd"), F.col("mean_iat"))
    return g.select(*entity, "n", "mean_iat", cv.alias("cv"), F.try_divide(F.lit(1.0), cv * cv).alias("shape"), ((cv > 0.5) & (cv < 1.5)).alias("poisson"))


def l_moments(df: DataFrame, entity: list[str], value: str = "value") -> DataFrame:
    """Sample L-moments l1, l2 and ratios t3, t4 by unbiased probability-weighted moments, from one ranking."""
    w = Window.partitionBy(*entity)
    d = df.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)).cast("double")).withColumn("_n", F.count("*").over(w).cast("double"))
    i, n, v = F.col("_i"), F.col("_n"), F.col(value)
    w1 = F.try_divide(i - 1, n - 1)
    w2 = w1 * F.try_divide(i - 2, n - 2)
    w3 = w2 * F.try_divide(i - 3, n - 3)
    g = d.groupBy(*entity).agg(F.count("*").alias("n"), F.avg(v).alias("b0"), F.avg(v * w1).alias("b1"), F.avg(v * w2).alias("b2"), F.avg(v * w3).alias("b3"))
    b0, b1, b2, b3 = (F.col(f"b{k}") for k in range(4))
    l2, l3, l4 = 2 * b1 - b0, 6 * b2 - 6 * b1 + b0, 20 * b3 - 30 * b2 + 12 * b1 - b0
    return g.select(*entity, "n", b0.alias("l1"), l2.alias("l2"), F.try_divide(l3, l2).alias("t3"), F.try_divide(l4, l2).alias("t4"))


def regional_l_moments(sites: DataFrame, region: list[str]) -> DataFrame:
    """Ratios pooled over sites with their record lengths as weights, and the weighted spread of the L-CV."""
    t = F.try_divide(F.col("l2"), F.col("l1"))
    n = F.col("n")
    w = Window.partitionBy(*region)
    mean = F.sum(n * t).over(w) / F.sum(n).over(w)
    d = sites.withColumn("_t", t).withColumn("_d", n * (t - mean) * (t - mean))
    pooled = lambda c: F.sum(n * c) / F.sum(n)
    return d.groupBy(*region).agg(F.count("*").alias("n_sites"), pooled(F.col("_t")).alias("t"), pooled(F.col("t3")).alias("t3"), pooled(F.col("t4")).alias("t4"), F.sqrt(F.sum("_d") / F.sum(n)).alias("spread"))


def pseudo_observations(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Ranks over n + 1 of each column, ties averaged, clipped to [1 / (n + 1), n / (n + 1)]."""
    out = df
    for c in columns:
        w = Window.partitionBy(*keys)
        n = F.count(c).over(w)
        r = F.rank().over(w.orderBy(F.col(c).asc_nulls_last())) + (F.count(c).over(Window.partitionBy(*keys, c)) - 1) / 2
        out = out.withColumn(f"u_{c}", F.when(F.col(c).isNotNull(), F.least(F.greatest(r / (n + 1), 1 / (n + 1)), n / (n + 1))))
    return out


def tail_dependence(df: DataFrame, keys: list[str], u: str, v: str, q: float) -> DataFrame:
    """Lower tail: P(v <= q | u <= q)."""
    low = F.col(u) <= q
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.sum((low & (F.col(v) <= q)).cast("double")), F.sum(low.cast("double"))).alias("lambda_low"))


def upper_tail_cfg(df: DataFrame, keys: list[str], u: str, v: str) -> DataFrame:
    """Upper tail coefficient by the Caperaa-Fougeres-Genest estimator."""
    a, b = F.sqrt(F.log(1 / F.col(u)) * F.log(1 / F.col(v))), F.log(1 / F.pow(F.greatest(F.col(u), F.col(v)), F.lit(2)))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), (2 - 2 * F.exp(F.avg(F.log(a / b)))).alias("lambda_up"))


def triple_collocation(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """Error variances of three products from their covariances, and weights by the inverses; negative ones are null."""
    c = lambda a, b: F.covar_samp(a, b)
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), *[c(a, b).alias(n) for n, a, b in (("xx", x, x), ("yy", y, y), ("zz", z, z), ("xy", x, y), ("xz", x, z), ("yz", y, z))])
    e = {"x": F.col("xx") - F.try_divide(F.col("xy") * F.col("xz"), F.col("yz")), "y": F.col("yy") - F.try_divide(F.col("xy") * F.col("yz"), F.col("xz")), "z": F.col("zz") - F.try_divide(F.col("xz") * F.col("yz"), F.col("xy"))}
    d = g.select(*keys, "n", *[F.when(v > 0, v).alias(f"err_{k}") for k, v in e.items()])
    total = sum((1 / F.col(f"err_{k}") for k in e), F.lit(0.0))
    return d.withColumns({f"weight_{k}": 1 / F.col(f"err_{k}") / total for k in e})


def tie_diagnostics(df: DataFrame, keys: list[str], u: str, quantiles: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """Share of values above each quantile against its nominal share."""
    q = F.explode(F.array(*map(F.lit, quantiles))).alias("q")
    return df.select(*keys, u, q).groupBy(*keys, "q").agg(F.avg((F.col(u) > F.col("q")).cast("double")).alias("share"), F.first(1 - F.col("q")).alias("nominal"))


def copula_cdf(family: str, theta: float, u: Column, v: Column) -> Column:
    """C(u, v) of a one-parameter copula."""
    t = F.lit(float(theta))
    if family == "clayton":
        return F.pow(F.pow(u, -t) + F.pow(v, -t) - 1, -1 / t)
    if family == "gumbel":
        return F.exp(-F.pow(F.pow(-F.log(u), t) + F.pow(-F.log(v), t), 1 / t))
    if family == "frank":
        return -F.log1p((F.exp(-t * u) - 1) * (F.exp(-t * v) - 1) / (F.exp(-t) - 1)) / t
    if family == "joe":
        a, b = F.pow(1 - u, t), F.pow(1 - v, t)
        return 1 - F.pow(a + b - a * b, 1 / t)
    if family == "independence":
        return u * v
    raise ValueError(f"no copula family {family}")


def joint_return_period(df: DataFrame, family: str, theta: float, u: str, v: str, mean_gap_months: str) -> DataFrame:
    """Years between events that pass both margins: mu / (12 (1 - u - v + C(u, v)))."""
    p = 1 - F.col(u) - F.col(v) + copula_cdf(family, theta, F.col(u), F.col(v))
    return df.withColumns({"p_both": p, "joint_years": F.try_divide(F.col(mean_gap_months), 12 * F.when(p > 1e-12, p))})


def shrunk_ratio(df: DataFrame, entity: list[str], observed: str, modelled: str, time: str = "month", full_at: int = 5, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Monthly median ratio of observed to modelled, drawn to the all-month median by min(1, n / 5), clipped to .5-2."""
    d = df.withColumn("_r", F.try_divide(observed, modelled)).withColumn("cal_month", F.month(time))
    all_months = d.groupBy(*entity).agg(F.median("_r").alias("prior"))
    by_month = d.groupBy(*entity, "cal_month").agg(F.count("_r").alias("n"), F.median("_r").alias("_m"))
    w = F.least(F.lit(1.0), F.col("n") / full_at)
    ratio = w * F.coalesce("_m", "prior") + (1 - w) * F.col("prior")
    return by_month.join(all_months, entity).select(*entity, "cal_month", "n", F.least(F.greatest(ratio, F.lit(low)), F.lit(high)).alias("ratio"))
