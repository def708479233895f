"""What a correction did to a series: its trend, its rare lows, and the bands that resampling and its error leave."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xeric.functions.labels import clip, normal_quantile
from xeric.functions.special import gamma_upper, log_gamma
from xeric.operators.frequency import l_moments
from xeric.operators.series import average_rank
from xeric.operators.trend import mann_kendall

#: Halvings of the interval in which the shape of an extreme value distribution is searched for.
HALVINGS = 60
#: Euler's constant, the mean of the standard Gumbel distribution.
EULER = 0.5772156649015329
#: Copies of one block in a resample: one of 8 or more has a probability of 1e-6 and counts as 8.
MOST_COPIES = 8


def _both(df: DataFrame, entity: list[str], time: str, raw: str, corrected: str, how) -> DataFrame:
    """(entity, year, series, value): a year's extreme of both series, taken before they are put below each other."""
    g = df.groupBy(*entity, F.year(time).alias("year")).agg(how(F.col(raw).cast("double")).alias("raw"), how(F.col(corrected).cast("double")).alias("corrected"))
    return g.unpivot([*entity, "year"], ["raw", "corrected"], "series", "value").filter("value is not null and not isnan(value)")


def _wide(df: DataFrame, entity: list[str], columns: list[str]) -> DataFrame:
    pick = lambda s, c: F.max(F.when(F.col("series") == s, F.col(c))).alias(f"{s}_{c}")
    return df.groupBy(*entity).agg(*[pick(s, c) for s in ("raw", "corrected") for c in columns])


def trend_preservation(df: DataFrame, entity: list[str], time: str, raw: str, corrected: str, most_change: float = 50.0, level: float = 0.1) -> DataFrame:
    """Sen's slope and Mann-Kendall p (continuity corrected) of the annual peaks before and after a correction.

    ``sign_flip`` is set where both slopes differ in sign and both p are below ``level``; ``altered`` where that is so or
    the slope moved by more than ``most_change`` percent. Entities of under two years have null slopes and no flag; a
    series that never changes has p 1; the change of a slope of 0 is null.
    """
    peaks = _both(df, entity, time, raw, corrected, F.max)
    mk = mann_kendall(peaks, [*entity, "series"], "year", "value")
    s = F.col("s")
    z = F.when(F.col("variance") > 0, (s - F.signum(s)) / F.sqrt("variance")).otherwise(0.0)
    d = _wide(mk.select(*entity, "series", "n", "sen", gamma_upper(F.lit(0.5), z * z / 2).alias("p")), entity, ["n", "sen", "p"])
    a, b = F.col("raw_sen"), F.col("corrected_sen")
    change = F.when(a != 0, F.abs((b - a) / a) * 100)
    flip = F.coalesce((F.signum(a) != F.signum(b)) & (F.col("raw_p") < level) & (F.col("corrected_p") < level), F.lit(False))
    return d.withColumns({"percent_change": change, "sign_flip": flip, "altered": flip | F.coalesce(change > most_change, F.lit(False))})


def extreme_value_shape(t3: Column) -> Column:
    """The shape k (negative: heavy upper tail) whose L-skewness is t3: 2 (1 - 3^-k) / (1 - 2^-k) - 3, by halvings between -1 and 20.

    Null outside of the interval's L-skewness, so for |t3| >= 1.
    """
    skew = lambda k: 2 * F.expm1(-k * F.log(F.lit(3.0))) / F.expm1(-k * F.log(F.lit(2.0))) - 3
    steps = F.array(*[F.lit(10.5 / 2**i) for i in range(1, HALVINGS)])
    # Skewness falls with k. The first place is no round number, so that no step can meet k = 0, where it is 0 / 0.
    k = F.aggregate(steps, F.lit(9.50000001), lambda at, step: at + F.when(skew(at) > t3, step).otherwise(-step))
    return F.when((t3 < 1) & (t3 > skew(F.lit(20.0))), k)


def extreme_value_quantile(l1: Column, l2: Column, k: Column, probability: Column | float) -> Column:
    """The quantile of the generalised extreme value distribution with these first L-moments and shape; its limit, Gumbel's, for |k| < 1e-6."""
    gamma = F.exp(log_gamma(1 + k))
    scale = l2 * k / (-F.expm1(-k * F.log(F.lit(2.0))) * gamma)
    place = l1 - scale * (1 - gamma) / k
    p = F.lit(probability) if isinstance(probability, float) else probability
    flat = l2 / F.log(F.lit(2.0))
    limit = l1 - flat * EULER - flat * F.log(-F.log(p))
    return F.when(F.abs(k) < 1e-6, limit).otherwise(place + scale / k * (1 - F.pow(-F.log(p), k)))


def return_level_change(df: DataFrame, entity: list[str], time: str, raw: str, corrected: str, periods: tuple[int, ...] = (20, 50), months: tuple[int, ...] = (1, 2, 3), least: int = 20, most_change: float = 25.0) -> DataFrame:
    """(entity, period, raw_level, corrected_level, percent_change, altered): levels of rare lows before and after a correction.

    Minima of ``months`` by year are fitted by L-moments; the level of a period is the quantile at one over it. Entities
    of under ``least`` years in a series, or whose minima have no spread between their quartiles, have no row. The change
    is null for a raw level within 1e-6 of 0.
    """
    lows = _both(df.filter(F.month(time).isin(*months)), entity, time, raw, corrected, F.min)
    keys = [*entity, "series"]
    spread = lows.groupBy(*keys).agg((F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("spread"))
    fit = l_moments(lows, keys).join(spread, keys).withColumn("k", extreme_value_shape(F.col("t3")))
    wide = _wide(fit, entity, ["n", "spread", "l1", "l2", "k"])
    wide = wide.filter((F.least("raw_n", "corrected_n") >= least) & (F.least("raw_spread", "corrected_spread") > 1e-6) & F.col("raw_n").isNotNull() & F.col("corrected_n").isNotNull())
    d = wide.withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))
    level = lambda s: extreme_value_quantile(F.col(f"{s}_l1"), F.col(f"{s}_l2"), F.col(f"{s}_k"), 1.0 / F.col("period"))
    d = d.select(*entity, "period", level("raw").alias("raw_level"), level("corrected").alias("corrected_level"))
    change = F.when(F.abs("raw_level") > 1e-6, 100 * (F.col("corrected_level") - F.col("raw_level")) / F.col("raw_level"))
    return d.withColumn("percent_change", change).withColumn("altered", F.coalesce(F.abs(change) > most_change, F.lit(False)))


def block_copies(block: Column, replicates: int, seed: int) -> Column:
    """How often each resample takes a block: Poisson variables of mean 1 from digests of the seed, the block and the resample's number."""
    uniform = lambda r: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), r.cast("string"))), 1, 13), 16, 10).cast("double") / 2.0**52
    cuts = [sum(exp(-1) / factorial(j) for j in range(i + 1)) for i in range(MOST_COPIES)]
    copies = lambda u: sum(((u >= c).cast("int") for c in cuts[1:]), (u >= cuts[0]).cast("int"))
    return F.transform(F.transform(F.sequence(F.lit(1), F.lit(replicates)), uniform), copies)


def resampled_band(df: DataFrame, entity: list[str], block: str, value: str, replicates: int = 200, seed: int = 1, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(entity, n_blocks, and mean, mean_low, mean_high, slope, slope_low, slope_high): percentile bands over resampled blocks.

    ``block`` is a whole number such as the year; the slope is the least squares slope of the value on it. Rows become
    sums by entity and block first, and only these meet the resamples, so all of them cost one pass over the rows. A
    block's copies depend on the seed, the block and the resample alone: reruns agree, and all entities take the same
    years, so that differences between them keep their dependence. Null and NaN values take no part. An entity of one
    block has a null slope, and resamples that took none of its blocks (or one, for slopes) are left out of its band.
    """
    v, t = F.col(value).cast("double"), F.col(block).cast("double")
    used = df.filter(v.isNotNull() & ~F.isnan(v) & F.col(block).isNotNull())
    sums = used.groupBy(*entity, block).agg(F.count("*").cast("double").alias("_n"), F.sum(v).alias("_v"))
    middle = F.avg(F.col(block).cast("double")).over(Window.partitionBy(*entity))  # whatever it is, slopes stay; sums stay small
    sums = sums.withColumn("_t", t - middle)
    every = F.concat(F.array(F.lit(1)), block_copies(F.col(block), replicates, seed))
    d = sums.select(*entity, "_n", "_v", "_t", F.posexplode(every).alias("_r", "_w")).filter("_w > 0")
    n = F.col("_w") * F.col("_n")
    parts = {"n": n, "v": F.col("_w") * F.col("_v"), "t": n * F.col("_t"), "tt": n * F.col("_t") * F.col("_t"), "tv": F.col("_w") * F.col("_t") * F.col("_v")}
    g = d.groupBy(*entity, "_r").agg(F.count("*").alias("_blocks"), *[F.sum(c).alias(f"_s{k}") for k, c in parts.items()])
    s = {k: F.col(f"_s{k}") for k in parts}
    spread = s["tt"] - s["t"] * s["t"] / s["n"]
    slope = F.when((F.col("_blocks") > 1) & (spread > 0), (s["tv"] - s["t"] * s["v"] / s["n"]) / spread)
    g = g.select(*entity, "_r", "_blocks", (s["v"] / s["n"]).alias("mean"), slope.alias("slope"))
    whole = lambda c: F.max(F.when(F.col("_r") == 0, F.col(c)))
    band = lambda c, q: F.percentile(F.when(F.col("_r") > 0, F.col(c)), F.lit(q))
    out = [e for c in ("mean", "slope") for e in (whole(c).alias(c), band(c, low).alias(f"{c}_low"), band(c, high).alias(f"{c}_high"))]
    return g.groupBy(*entity).agg(whole("_blocks").alias("n_blocks"), *out)


def reference_index(df: DataFrame, entity: list[str], value: str, time: str, first: str, last: str, least: int = 15, eps: float = 1e-6) -> DataFrame:
    """df's rows with ``z`` and ``method``: the normal score of each value by calendar month against a reference period.

    1: a gamma distribution of the reference's positive values by L-moments, mixed with its share of zeros. 2: plotting
    positions (rank - 0.44) / (n + 0.12) of all years where the reference has under ``least`` values, a variance below
    0.01, or too few positive values for a fit; it needs three values. 3: z is 0 where the reference does not vary.
    Null and NaN values have neither; negative ones count as 0 in the fit.
    """
    v = F.when(F.isnan(F.col(value).cast("double")), None).otherwise(F.greatest(F.col(value).cast("double"), F.lit(0.0)))
    v = F.when(F.col(value).isNotNull(), v)
    d = df.withColumn("_v", v).withColumn("_month", F.month(time))
    keys = [*entity, "_month"]
    ref = d.filter(F.col(time).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    sample = ref.groupBy(*keys).agg(F.count("_v").alias("_n"), F.var_samp("_v").alias("_var"), F.avg((F.col("_v") <= 0).cast("double")).alias("_dry"))
    fit = l_moments(ref.filter("_v > 0"), keys, "_v").select(*keys, F.col("n").alias("_wet"), "l1", F.try_divide(F.col("l2"), F.col("l1")).alias("_t"))
    t = F.col("_t")
    near, far = 3.141592653589793 * t * t, 1 - t
    shape = F.when(t < 0.5, (1 - 0.3080 * near) / (near - 0.05812 * near * near + 0.01765 * F.pow(near, F.lit(3)))).otherwise((0.7213 * far - 0.5947 * far * far) / (1 - 2.1817 * far + 1.2113 * far * far))
    fit = fit.withColumn("_shape", F.when((t > 0) & (t < 1) & (F.col("_wet") >= 4), shape))
    d = average_rank(d, keys, "_v").withColumn("_all", F.count("_v").over(Window.partitionBy(*keys)))
    d = d.join(sample, keys, "left").join(fit, keys, "left")
    seen = F.col("_v").isNotNull()
    fixed = F.col("_n") >= least
    method = F.when(seen & fixed & (F.col("_var") < 2.2e-16), 3).when(seen & fixed & (F.col("_var") >= 0.01) & F.col("_shape").isNotNull(), 1).when(seen & (F.col("_all") >= 3), 2)
    wet = F.when(F.col("_v") > 0, 1 - gamma_upper(F.col("_shape"), F.col("_v") * F.col("_shape") / F.col("l1"))).otherwise(0.0)
    p = F.when(F.col("method") == 1, F.col("_dry") + (1 - F.col("_dry")) * wet).when(F.col("method") == 2, (F.col("rank") - 0.44) / (F.col("_all") + 0.12))
    d = d.withColumn("method", method).withColumn("_p", clip(p, eps, 1 - eps)).withColumn("z", F.when(F.col("method") == 3, 0.0).otherwise(normal_quantile("_p")))
    return d.select(*df.columns, "z", "method")


def index_band(df: DataFrame, entity: list[str], value: str, time: str, error: float | Column, first: str, last: str, least: int = 15) -> DataFrame:
    """(entity, time, z, z_lower, z_upper, method): the index of a series, and of the series moved by its error either way.

    The series plus and minus ``error`` (the latter 0 at least) is fitted anew, and the lesser and greater of both are
    the band, which is null where either is. Three rows a value, one pass.
    """
    moved = F.array(F.lit(0.0), F.lit(1.0), F.lit(-1.0))
    d = df.select(*entity, time, F.col(value).cast("double").alias("_value"), (F.lit(error) if isinstance(error, float) else error).alias("_e"))
    d = d.withColumn("_side", F.explode(moved)).withColumn("_value", F.when(F.col("_side") == 0, F.col("_value")).otherwise(F.greatest(F.col("_value") + F.col("_side") * F.col("_e"), F.lit(0.0))))
    d = d.withColumn("_value", F.when(F.col("_value").isNotNull() & F.col("_e").isNotNull(), F.col("_value")))
    x = reference_index(d, [*entity, "_side"], "_value", time, first, last, least)
    at = lambda side, c="z": F.max(F.when(F.col("_side") == side, F.col(c)))
    g = x.groupBy(*entity, time).agg(at(0).alias("z"), at(1).alias("_up"), at(-1).alias("_down"), at(0, "method").alias("method"))
    both = F.col("_up").isNotNull() & F.col("_down").isNotNull()
    return g.select(*entity, time, "z", F.when(both, F.least("_up", "_down")).alias("z_lower"), F.when(both, F.greatest("_up", "_down")).alias("z_upper"), "method")
