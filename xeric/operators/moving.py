"""Operators on fits that move or pool: copula choice and tests, changing margins, growth curves, regions, thresholds."""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xeric.functions import fit_kernels as M
from xeric.functions.labels import clip
from xeric.sources.scratch import written

from .indices import _by_calendar_month
from .risk import _per_record
from .ordered import exact_quantiles, false_discovery


def _doubles(df: DataFrame, entity: list[str], time: str, columns: list[str]) -> DataFrame:
    return df.select(*entity, F.col(time).alias("month"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).dropna()


def _arrays(pdf: pd.DataFrame, n: int) -> list[np.ndarray]:
    return [pdf[f"_{i}"].to_numpy(float) for i in range(n)]


def _years(pdf: pd.DataFrame) -> np.ndarray:
    return pd.to_datetime(pdf["month"]).dt.year.to_numpy(float)


def copula_choice(df: DataFrame, entity: list[str], u: str, v: str, time: str = "month", least: int = 15) -> DataFrame:
    """The copula of two pseudo-observations among seven families, with the preference for Joe or Gumbel."""

    def run(pdf):
        if len(pdf) >= least:
            a, b = _arrays(pdf, 2)
            tail, ok = M.upper_tail(a, b), M.tail_ties_ok(b)
            yield (len(pdf), *M.choose_copula(a, b, tail, ok), tail)

    schema = "n int, family string, parameter double, aic double, tau double, upper_tail double"
    return _per_record(_doubles(df, entity, time, [u, v]), entity, ["_0", "_1"], run, schema)


def copula_fit_test(df: DataFrame, entity: list[str], u: str, v: str, time: str = "month", draws: int = 499, least: int = 15) -> DataFrame:
    """The chosen copula and the p of its parametric bootstrap, by entity."""

    def run(pdf):
        if len(pdf) >= least:
            yield M.goodness_of_fit(*_arrays(pdf, 2), draws)

    return _per_record(_doubles(df, entity, time, [u, v]), entity, ["_0", "_1"], run, "family string, parameter double, distance double, p double")


def copula_stability(df: DataFrame, entity: list[str], u: str, raw: str, time: str = "month", seeds: int = 30, least: int = 15) -> DataFrame:
    """How far the choice of a copula depends on the seed that spreads ties at the largest raw value."""

    def run(pdf):
        if len(pdf) >= least:
            yield M.family_stability(*_arrays(pdf, 2), seeds)

    return _per_record(_doubles(df, entity, time, [u, raw]), entity, ["_0", "_1"], run, "family string, share double, parameter_cv double, stable boolean")


def moving_copula(df: DataFrame, entity: list[str], u: str, v: str, time: str = "month", least: int = 20) -> DataFrame:
    """Copula with a constant, a drifting or a split parameter, by entity."""

    def run(pdf):
        if len(pdf) >= least:
            yield M.moving_copula(*_arrays(pdf, 2), _years(pdf))

    schema = "family string, model string, slope double, p double, bic_constant double, bic_line double, bic_split double"
    return _per_record(_doubles(df, entity, time, [u, v]), entity, ["_0", "_1"], run, schema)


def moving_gamma(df: DataFrame, entity: list[str], value: str, time: str = "month", least: int = 20) -> DataFrame:
    """Gamma margin of an entity's positive values, with a mean and spread that may move with the year."""

    def run(pdf):
        (x,) = _arrays(pdf, 1)
        if len(x) >= least and x.std() > 0:
            yield M.moving_gamma(x, _years(pdf))

    schema = "model string, p double, early_mean double, late_mean double, early_cv double, late_cv double, aic_constant double, aic_mean double, aic_both double"
    return _per_record(_doubles(df.filter(F.col(value) > 0), entity, time, [value]), entity, ["_0"], run, schema)


def composite_bootstrap(df: DataFrame, entity: list[str], event: str, value: str, time: str = "month", draws: int = 5000, block: int = 6) -> DataFrame:
    """Event composite of each entity with a moving-block interval and p, adjusted for all entities' false discoveries.

    Entities without event or other months are left out. The adjustment puts no entities in order in one task.
    """

    def run(pdf):
        e, x = _arrays(pdf, 2)
        if 0 < e.sum() < len(e):
            yield M.block_bootstrap_p(e > 0.5, x, draws, block)

    d = df.withColumn("_event", F.col(event).cast("int"))
    got = _per_record(_doubles(d, entity, time, ["_event", value]), entity, ["_0", "_1"], run, "difference double, low double, high double, p double")
    return false_discovery(written(got.withColumn("p", F.when(~F.isnan("p"), F.col("p"))), "composites"), [])


def bias_shift(df: DataFrame, entity: list[str], bias: str, balance: str, early: Column, late: Column, time: str = "month", draws: int = 2000) -> DataFrame:
    """Change of the mean bias from early to late years by calendar month, also over the early spread of the balance.

    The interval resamples the late values. Calendar months without early or with under two late values have no row.
    """
    d = df.withColumn("cal_month", F.month(time)).withColumns({"_e": early, "_l": late})
    base = d.filter(F.col("_e") & F.col(balance).isNotNull() & F.col(bias).isNotNull()).groupBy(*entity, "cal_month")
    base = base.agg(F.count("*").alias("n_early"), F.avg(bias).alias("_base"), F.stddev_samp(balance).alias("_sd"))
    rows = d.filter(F.col("_l") & F.col(bias).isNotNull()).select(*entity, "cal_month", F.col(time).alias("month"), F.col(bias).cast("double").alias("_b"))
    rows = rows.join(base, [*entity, "cal_month"])

    def run(pdf):
        x = pdf["_b"].to_numpy(float)
        if len(x) >= 2:
            b = float(pdf["_base"].iloc[0])
            yield int(pdf["n_early"].iloc[0]), len(x), float(pdf["_sd"].iloc[0]), float(x.mean() - b), *M.mean_shift_interval(x, b, draws)

    got = _per_record(rows, [*entity, "cal_month"], ["_b", "_base", "_sd", "n_early"], run, "n_early int, n_late int, sd double, delta double, low double, high double")
    sd = F.when((F.col("sd") > 0) & ~F.isnan("sd"), F.col("sd"))
    return got.select(*entity, "cal_month", "n_early", "n_late", "delta", "low", "high", *[(F.col(c) / sd).alias(f"{c}_index") for c in ("delta", "low", "high")])


def growth_curve(pooled: DataFrame, region: list[str], years: tuple[float, ...] = (2, 5, 10, 25, 50, 100), heterogeneity: DataFrame | None = None, most: float = 2.0) -> DataFrame:
    """Regional growth factors by return period: a generalised logistic of mean 1 from the pooled L-CV and L-skewness.

    ``pooled`` is what ``regional_l_moments`` gives. Regions of under three sites have none, nor those whose h in
    ``heterogeneity`` (region, h) is not below ``most``; without that table only the sites are counted.
    """
    d = pooled.filter((F.col("n_sites") >= 3) & (F.abs("t3") < 1))
    if heterogeneity is not None:
        d = d.join(heterogeneity.filter(F.col("h") < most).select(*region), region, "left_semi")
    k = -F.col("t3")
    odds = 1.0 / (F.col("years") - 1)
    small = F.abs(k) < 1e-9
    kp = k * pi
    scale = F.when(small, F.col("t")).otherwise(F.col("t") * F.sin(kp) / kp)
    place = F.when(small, F.lit(1.0)).otherwise(1 - scale * (1 / k - pi / F.sin(kp)))
    q = F.when(small, place - scale * F.log(odds)).otherwise(place + scale / k * (1 - F.pow(odds, k)))
    d = d.withColumn("years", F.explode(F.array(*[F.lit(float(y)) for y in years])))
    return d.select(*region, "n_sites", "years", q.alias("growth"))


def site_quantiles(growth: DataFrame, sites: DataFrame, region: list[str], site: str) -> DataFrame:
    """Each site's value by return period: its mean (l1) times its region's growth factor, a row a region and period."""
    return sites.select(*region, site, "l1").join(growth, region).select(*region, site, "years", (F.col("l1") * F.col("growth")).alias("value"))


def kmeans_regions(pixels: DataFrame, pixel: str, features: list[str], k: int = 6, seed: int = 42) -> DataFrame:
    """Regions of pixels by k-means of their standardised features; pixels lacking one have none.

    Regions are numbered from 0 by their centres' order, so that reruns name them alike.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    d = pixels.select(pixel, *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    d = VectorAssembler(inputCols=features, outputCol="_raw").transform(d)
    d = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(d).transform(d)
    model = KMeans(featuresCol="_x", predictionCol="_c", k=k, seed=seed).fit(d)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    number = F.array(*[F.lit(order.index(i)) for i in range(len(order))])
    return model.transform(d).select(pixel, number[F.col("_c")].alias("region"))


def threshold_search(cover: DataFrame, values: DataFrame, cell: str, thresholds: tuple[float, ...], time: str = "month", stable: float = 0.5, targets: tuple[float, float, float] = (20, 0.5, 50)) -> DataFrame:
    """Score of each snow-cover threshold: (threshold, diagnostics, score), best first by ``rank``.

    ``cover`` is (cell, cal_month, cover), ``values`` (cell, time, value). A cell's calendar month is retained if its
    cover reaches the threshold. A cell's stability is the share of its retained years with a positive value, 0 for cells
    without a retained value; with no such cell left the share without snow is null and scores 0. The score weighs the median of years with snow, the median share without, the stable cells
    and what is retained by 0.30, 0.25, 0.20 and 0.15 and adds 0.05; equal scores go to the lower threshold. The join is
    on cell and month once; thresholds are exploded on the cover rows that reach them, and years are counted by cell.
    """
    listed = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    kept = cover.filter("cover is not null").withColumn("threshold", F.explode(F.filter(listed, lambda t: t <= F.col("cover"))))
    cells = cover.select(cell).union(values.select(cell)).distinct()
    share = kept.groupBy("threshold").agg(F.count("*").alias("_kept"))
    v = values.select(cell, F.month(time).alias("cal_month"), F.year(time).alias("_y"), (F.coalesce(F.col("value"), F.lit(0.0)) > 0).alias("_p"))
    by_year = kept.select(cell, "cal_month", "threshold").join(v, [cell, "cal_month"]).groupBy(cell, "threshold", "_y").agg(F.max("_p").alias("_p"))
    by_cell = by_year.groupBy(cell, "threshold").agg(F.sum(F.col("_p").cast("int")).alias("_years"), F.avg(F.col("_p").cast("double")).alias("_stable"))
    every = cells.withColumn("threshold", F.explode(listed)).join(by_cell, [cell, "threshold"], "left")
    every = every.select("threshold", "_stable", (1 - F.col("_stable")).alias("_zero"), F.coalesce("_years", F.lit(0)).alias("_years"))
    every = written(every, "thresholds")
    middle = lambda c, name: exact_quantiles(every, c, [0.5], ["threshold"]).select("threshold", F.col("quantiles")[0].alias(name))
    g = every.groupBy("threshold").agg(
        F.count("*").alias("_cells"), (100 * F.avg((F.coalesce("_stable", F.lit(0.0)) >= stable).cast("double"))).alias("stable_pct")
    )
    for part in (middle("_zero", "zero_share"), middle("_years", "snow_years"), share):  # a row a threshold
        g = g.join(F.broadcast(part), "threshold", "left")
    retained = F.coalesce("_kept", F.lit(0)) / (12 * F.col("_cells"))
    part = lambda c: F.least(c, F.lit(1.0))
    years, zero, pct = (float(t) for t in targets)
    zeros = F.when(F.col("zero_share").isNull(), 0.0).otherwise(part(zero / (F.col("zero_share") + 1e-9)))
    score = 0.30 * part(F.col("snow_years") / years) + 0.25 * zeros + 0.20 * part(F.col("stable_pct") / pct)
    score = score + 0.15 * F.when(retained < 0.2, 0.0).otherwise(F.least(retained, F.lit(0.95))) + 0.05
    d = g.select("threshold", retained.alias("retained"), "zero_share", "snow_years", "stable_pct", F.round(score, 9).alias("score"))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "threshold")))  # one row a threshold


def fitted_supply(df: DataFrame, entity: list[str], weights: dict[str, float], time: str = "month", least: int = 2, cap: float = 4.2) -> DataFrame:
    """Surface supply whose components are scored by a gamma fit of their calendar month, or places where none fits.

    Components are stacked, scored in one pass and summed back, so that there are two shuffles however many there are.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(float(w)).alias("weight"), F.col(c).cast("double").alias("x")) for c, w in weights.items()]))
    long = df.select(*entity, F.col(time).alias("month"), stack.alias("s")).select(*entity, "month", "s.*")
    z = _by_calendar_month(long, [*entity, "component", "weight"], lambda x, y: M.gamma_or_places(x), "x", "month", "method string")
    there = F.when(F.col("z").isNotNull(), F.col("weight"))
    g = z.groupBy(*entity, "month").agg(F.sum(F.col("z") * F.col("weight")).alias("_s"), F.sum(there).alias("_w"), F.count("z").alias("_n"))
    return g.select(*entity, "month", clip(F.when(F.col("_n") >= least, F.try_divide("_s", "_w")), -cap, cap).alias("supply"))


def effect_bounds(df: DataFrame, entity: list[str], x: str, w: str, y: str, time: str = "month", least: int = 10) -> DataFrame:
    """Where x's effect on y is significant along the moderator w (Johnson and Neyman), by entity; bounds may be null."""

    def run(pdf):
        if len(pdf) >= least:
            yield tuple(v if np.isfinite(v) else None for v in M.johnson_neyman(*_arrays(pdf, 3)))

    return _per_record(_doubles(df, entity, time, [x, w, y]), entity, ["_0", "_1", "_2"], run, "effect double, change double, low double, high double")


def layer_month(origin: str, layer: Column, first: int = 1900, last: int = 2030) -> Column:
    """The month of a layer counted from ``origin``; null outside the years first..last."""
    d = F.add_months(F.lit(origin).cast("date"), layer.cast("int"))
    return F.when(F.year(d).between(first, last), d)


def padded_layers(df: DataFrame, layer: str, size: int) -> DataFrame:
    """All layers 0..size - 1, without values where ``df`` has none; one broadcast-free join on the layer."""
    every = df.sparkSession.range(size).select(F.col("id").alias(layer))
    return every.join(df.withColumn(layer, F.col(layer).cast("long")), layer, "left")
