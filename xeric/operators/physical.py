"""Physical scalar functions: evapotranspiration, storage, dates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vapour_pressure(t: Column) -> Column:
    """Saturation vapour pressure in kPa at t degrees Celsius."""
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def penman_monteith(df: DataFrame, entity: list[str], time: str = "month") -> DataFrame:
    """Monthly reference evapotranspiration (mm/day), from t, tdew (C), wind at 10 m, pressure (kPa), rs, ra (MJ/m2/day).

    The soil heat flux is 0.14 times the change of t from the month before, held to 0.3 of |rn| in frost; not below 0.
    """
    t, u10 = F.col("t"), F.col("wind")
    es, ea = vapour_pressure(t), vapour_pressure(F.col("tdew"))
    slope = 4098 * es / F.pow(t + 237.3, F.lit(2))
    gamma = 0.000665 * F.col("pressure")
    u2 = u10 * 4.87 / math.log(67.8 * 10 - 5.42)
    rns = (1 - 0.23) * F.col("rs")
    rso = 0.75 * F.col("ra")
    cloud = F.least(F.greatest(1.35 * F.try_divide(F.col("rs"), rso) - 0.35, F.lit(0.05)), F.lit(1.0))
    rnl = 4.903e-9 * F.pow(t + 273.16, F.lit(4)) * (0.34 - 0.14 * F.sqrt(ea)) * cloud
    rn = rns - rnl
    change = t - F.coalesce(F.lag(t).over(Window.partitionBy(*entity).orderBy(time)), t)
    g = 0.14 * change
    cap = 0.3 * F.abs(rn)
    g = F.when(t < 0, F.least(F.greatest(g, -cap), cap)).otherwise(g)
    et = (0.408 * slope * (rn - g) + gamma * 900 / (t + 273) * u2 * F.greatest(es - ea, F.lit(0.0))) / (slope + gamma * (1 + 0.34 * u2))
    return df.withColumn("et0", F.greatest(et, F.lit(0.0)))


def thornthwaite(df: DataFrame, entity: list[str], time: str = "month", t: str = "t", lat: str = "lat", first_year: int | None = 1991, last_year: int | None = 2020) -> DataFrame:
    """Monthly potential evapotranspiration in mm/day from temperature and latitude.

    The heat index comes from the calendar months' means of the reference years (of all years if first_year is None).
    """
    reference = df if first_year is None else df.filter(F.year(time).between(first_year, last_year))
    months = reference.groupBy(*entity, F.month(time).alias("_m")).agg(F.avg(t).alias("_t"))
    heat = months.groupBy(*entity).agg(F.sum(F.pow(F.greatest("_t", F.lit(0.0)) / 5, F.lit(1.514))).alias("heat"))
    i = F.col("heat")
    a = 6.75e-7 * i * i * i - 7.71e-5 * i * i + 1.792e-2 * i + 0.49239
    d = df.join(heat, entity)
    mid = F.dayofyear(F.date_add(F.trunc(time, "MM"), 14))
    decl = 0.409 * F.sin(2 * math.pi / 365 * mid - 1.39)
    angle = F.acos(F.least(F.greatest(-F.tan(F.radians(F.col(lat))) * F.tan(decl), F.lit(-1.0)), F.lit(1.0)))
    days = F.dayofmonth(F.last_day(time))
    pet = 16 * (24 / math.pi * angle / 12) * (days / 30) * F.pow(F.try_divide(10 * F.greatest(F.col(t), F.lit(0.0)), i), a)
    return d.withColumn("pet", F.when(F.col(t) <= 0, 0.0).otherwise(pet / days))


#: Most rows of a curve, all lakes together, that are broadcast.
CURVE_ROWS = 100_000


def stage_storage(readings: DataFrame, curve: DataFrame, stage: str = "stage", lake: tuple[str, ...] = ()) -> DataFrame:
    """Storage by linear interpolation on a stage-storage curve, null outside it.

    Levels are cut into as many equal bins as the curve has rows. A segment is listed in the bins it crosses, so a
    reading meets the few segments of its bin by an equi-join (by broadcast for curves of up to CURVE_ROWS rows) and
    not the whole curve. Curves of many lakes are told apart by the ``lake`` columns.
    """
    low, high, n = curve.agg(F.min("level"), F.max("level"), F.count("*")).first()
    if n < 2 or high == low:
        return readings.withColumn("storage", F.lit(None).cast("double"))
    bin_of = lambda c: F.floor((c - F.lit(low)) * F.lit(n / (high - low)))
    w = Window.partitionBy(*lake).orderBy("level")
    seg = curve.select(*lake, F.col("level").alias("a"), F.col("storage").alias("sa"), F.lead("level").over(w).alias("b"), F.lead("storage").over(w).alias("sb"))
    seg = seg.withColumn("_last", F.col("b") == F.max("b").over(Window.partitionBy(*lake))).filter("b is not null")
    seg = seg.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("a")), bin_of(F.col("b")))))
    s = F.col(stage)
    r = readings.withColumn("_bin", bin_of(s))
    seg = seg.select(*[F.col(c).alias(f"_{c}") for c in lake], F.col("_bin").alias("_seg_bin"), "a", "sa", "b", "sb", "_last")
    inside = (r["_bin"] == F.col("_seg_bin")) & (s >= F.col("a")) & ((s < F.col("b")) | (F.col("_last") & (s == F.col("b"))))
    for c in lake:
        inside &= r[c] == F.col(f"_{c}")
    j = r.join(F.broadcast(seg) if n <= CURVE_ROWS else seg, inside, "left")
    value = F.col("sa") + (s - F.col("a")) / (F.col("b") - F.col("a")) * (F.col("sb") - F.col("sa"))
    return j.withColumn("storage", value).drop("a", "sa", "b", "sb", "_last", "_bin", "_seg_bin", *[f"_{c}" for c in lake])


def power_law_area(level: Column, width: float, floor: float, scale: float, power: float) -> Column:
    """Area width * ((level - floor) / scale) ** power, 0 below the floor."""
    return width * F.pow(F.greatest(level - floor, F.lit(0.0)) / scale, F.lit(power))


def power_law_storage(level: Column, width: float, floor: float, scale: float, power: float) -> Column:
    """The integral of power_law_area from the floor to the level."""
    return width * scale / (power + 1) * F.pow(F.greatest(level - floor, F.lit(0.0)) / scale, F.lit(power + 1))


def hypsometric_volume(curve: DataFrame, lake: list[str]) -> DataFrame:
    """Volume below each elevation by trapezoids over (elevation, area)."""
    w = Window.partitionBy(*lake).orderBy("elevation")
    step = (F.col("elevation") - F.lag("elevation").over(w)) * (F.col("area") + F.lag("area").over(w)) / 2
    return curve.withColumn("_v", F.coalesce(step, F.lit(0.0))).withColumn("volume", F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_v")


def active_storage(storage: Column, dead: Column, environmental: Column) -> Column:
    return F.greatest(F.lit(0.0), storage - dead - environmental)


def storage_deficit(df: DataFrame, entity: list[str], value: str = "value", time: str = "month") -> DataFrame:
    """TSD = (S - mean) / (max - min) * 100 by calendar month, as ``tsd``; null without a value or any spread."""
    w = Window.partitionBy(*entity, F.month(time))
    v = F.col(value)
    return df.withColumn("tsd", F.try_divide(v - F.avg(v).over(w), F.max(v).over(w) - F.min(v).over(w)) * 100)


def storage_deficit_index(df: DataFrame, entity: list[str], p: float | None = None, q: float | None = None, value: str = "value", time: str = "month", fitted: DataFrame | None = None) -> DataFrame:
    """Total storage deficit and its recurrence T_i = p T_(i-1) + q TSD_i, which starts at 0.02 TSD; null months carry on.

    p and q are given, or each entity's own from ``fitted`` (see deficit_recurrence; entities without them have none).
    Each entity's record is folded once, in time order, in one pass.
    """
    d = storage_deficit(df, entity, value, time).select(*entity, F.col(time).alias("month"), "tsd")
    d = d.join(fitted.select(*entity, "p", "q"), entity) if fitted is not None else d.withColumns({"p": F.lit(float(p)), "q": F.lit(float(q))})
    kinds = dict(d.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        a, b, last, out = pdf["p"].iloc[0], pdf["q"].iloc[0], None, []
        for x in pdf["tsd"].tolist():
            if x == x and x is not None:
                last = 0.02 * x if last is None else a * last + b * x
            out.append(last)
        return pdf[[*entity, "month", "tsd"]].assign(index=out)

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*entity, "month"]) + ", tsd double, index double"
    return d.groupBy(*entity).applyInPandas(run, schema).withColumnRenamed("month", time)


def deficit_recurrence(tsd: DataFrame, entity: list[str], drought_class: float = -3.0, least: int = 6, time: str = "month") -> DataFrame:
    """p and q of the storage deficit's recurrence, from the line of the cumulated TSD over one dry run.

    A dry run is a run of negative TSD among the months that have one. The line runs over the months since its start
    (days / 30.44), its slope m and intercept b give p = 1 - m / (m + b) and q = class / (m + b). The run at whose end
    all TSD cumulate to the least is taken; if it has under ``least`` months, the longest; else, or where p is not
    between 0 and 1, the next by that order which allows one. Returns ``entity, start, n_run, p, q``.
    """
    w = Window.partitionBy(*entity).orderBy(time)
    dry = F.col("tsd") < 0
    rows = tsd.filter("tsd is not null").withColumn("_all", F.sum("tsd").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_new", (dry & ~F.coalesce(F.lag(dry).over(w), F.lit(False))).cast("int"))
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(dry)
    own = Window.partitionBy(*entity, "run").orderBy(time)
    rows = rows.withColumn("_t", F.datediff(F.col(time), F.min(time).over(Window.partitionBy(*entity, "run"))) / 30.44)
    rows = rows.withColumn("_c", F.sum("tsd").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*entity, "run").agg(
        F.min(time).alias("start"), F.count("*").alias("n_run"), F.max_by("_all", time).alias("_score"), F.regr_slope("_c", "_t").alias("_m"), F.regr_intercept("_c", "_t").alias("_b"))
    e = Window.partitionBy(*entity)
    runs = runs.withColumn("_deep", F.row_number().over(e.orderBy("_score", "start"))).withColumn("_long", F.row_number().over(e.orderBy(F.col("n_run").desc(), "start")))
    runs = runs.withColumn("_short", F.max(((F.col("_deep") == 1) & (F.col("n_run") < least)).cast("int")).over(e))
    both = F.col("_m") + F.col("_b")
    p = 1 - F.col("_m") / both
    runs = runs.filter((F.col("n_run") >= least) & (F.abs(both) >= 1e-6)).withColumns({"p": p, "q": F.lit(drought_class) / both}).filter("p > 0 and p < 1")
    order = F.when((F.col("_short") == 1) & (F.col("_long") == 1), 0).otherwise(F.col("_deep"))
    return runs.withColumn("_o", F.row_number().over(e.orderBy(order, "start"))).filter("_o = 1").select(*entity, "start", "n_run", "p", "q")
