"""Return periods of events, their place in the record, and how dependence moves with time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import average_rank


def overlapping(events: DataFrame, others: DataFrame, entity: list[str]) -> DataFrame:
    """Pairs of events of one entity whose spans meet: an equi-join on the entity with the interval as its condition."""
    o = others.select(*entity, F.col("start").alias("other_start"), F.col("finish").alias("other_finish"))
    return events.join(o, entity).filter((F.col("start") <= F.col("other_finish")) & (F.col("finish") >= F.col("other_start")))


def class_subset(events: DataFrame, least: int = 15, by: str = "class") -> DataFrame:
    """Events of the classes that hold at least ``least`` of them."""
    enough = events.groupBy(by).count().filter(F.col("count") >= least).select(by)
    return events.join(enough, by, "left_semi")


def plotting_return_period(months: DataFrame, entity: list[str], first_year: int, last_year: int, value: str = "value", time: str = "month") -> DataFrame:
    """(n + 1) / rank of the yearly maximum that is nearest to the mean of the focus years (of equals the larger one)."""
    year = F.year(time)
    focus = months.filter(year.between(first_year, last_year)).groupBy(*entity).agg(F.avg(value).alias("focus"))
    maxima = months.groupBy(*entity, year.alias("year")).agg(F.max(value).alias("top")).filter("top is not null")
    w = Window.partitionBy(*entity)
    ranked = maxima.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("top").desc(), "year")))
    near = ranked.join(focus, entity).withColumn("_near", F.row_number().over(w.orderBy(F.abs(F.col("top") - F.col("focus")), "_r")))
    return near.filter("_near = 1").select(*entity, "focus", "top", ((F.col("_n") + 1) / F.col("_r")).alias("years"))


def continuised(df: DataFrame, entity: list[str], value: str, key: list[str], least: int = 2, eps: float = 1e-6, out: str = "u") -> DataFrame:
    """Pseudo-observations of a series whose largest value is an atom: ranks below it, places in its own share at it.

    The places come from a hash of ``key``, so reruns agree. Under ``least`` rows at the maximum, plain ranks r / (n + 1).
    """
    w = Window.partitionBy(*entity)
    v = F.col(value)
    top = F.max(v).over(w)
    d = df.filter(v.isNotNull()).withColumn("_top", (v >= top - eps).cast("int"))
    d = d.withColumn("_k", F.sum("_top").over(w)).withColumn("_top", F.when(F.col("_k") >= least, F.col("_top")).otherwise(0))
    d = d.withColumn("_p", F.sum("_top").over(w) / F.count("*").over(w)).withColumn("_n", F.count("*").over(w) - F.sum("_top").over(w))
    d = average_rank(d, [*entity, "_top"], value, "_rank")
    place = (F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    u = F.when(F.col("_top") == 1, 1 - F.col("_p") + F.col("_p") * place).otherwise((1 - F.col("_p")) * F.col("_rank") / (F.col("_n") + 1))
    return d.withColumn(out, F.least(F.greatest(u, F.lit(eps)), F.lit(1 - eps))).withColumn("p_top", F.col("_p")).drop("_top", "_k", "_p", "_n", "_rank")


def rolling_tau(df: DataFrame, entity: list[str], x: str, y: str, half: int = 6, least: int = 6, time: str = "month") -> DataFrame:
    """Kendall's tau-b of the rows up to ``half`` before and after each; null in short windows or without variance.

    Pairs are counted inside each window's array, of 2 * half + 1 rows at most, so nothing is joined.
    """
    w = Window.partitionBy(*entity).orderBy(time).rowsBetween(-half, half)
    d = df.withColumn("_w", F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(w))
    counts = F.expr(
        """aggregate(sequence(1, size(_w) - 1), named_struct('s', 0L, 'a', 0L, 'b', 0L), (acc, i) -> aggregate(slice(_w, 1, i), acc, (t, e) -> named_struct(
        's', t.s + cast(sign(_w[i].x - e.x) * sign(_w[i].y - e.y) as bigint), 'a', t.a + if(_w[i].x = e.x, 0L, 1L), 'b', t.b + if(_w[i].y = e.y, 0L, 1L))))"""
    )
    d = d.withColumn("_c", F.when(F.size("_w") >= least, counts))
    tau = F.try_divide(F.col("_c.s"), F.sqrt(F.col("_c.a").cast("double") * F.col("_c.b")))
    return d.withColumn("n_window", F.size("_w").cast("long")).withColumn("tau", tau).drop("_w", "_c")


def event_placement(months: DataFrame, events: DataFrame, entity: list[str], severity: str, area: str, theta: float = 2.0, time: str = "month") -> DataFrame:
    """Joint return periods of each event's peak month and of its mean, under a Gumbel copula.

    ``months`` holds the active months with their severity and area; margins are their shares at or below, over n + 1.
    Means are rounded to nine places, so that a mean of equal values is at them. p = 1 - u - v + C and T = mu / (12 p), with mu the mean months between the entity's event starts.
    """
    w = Window.partitionBy(*entity).orderBy("start")
    gap = F.months_between("start", F.lag("start").over(w))
    mu = events.withColumn("_gap", gap).groupBy(*entity).agg(F.avg("_gap").alias("mu"))
    inside = months.join(events.select(*entity, "event", "start", "finish"), entity).filter(F.col(time).between(F.col("start"), F.col("finish")))
    peak = F.max(F.struct(F.col(severity), F.col(area)))
    kinds = inside.groupBy(*entity, "event", "start").agg(peak.alias("p"), F.round(F.avg(severity), 9).alias("ms"), F.round(F.avg(area), 9).alias("ma"))
    kinds = kinds.select(*entity, "event", "start", F.explode(F.array(F.struct(F.lit("peak").alias("kind"), F.col(f"p.{severity}").alias("s"), F.col(f"p.{area}").alias("a")), F.struct(F.lit("mean").alias("kind"), F.col("ms").alias("s"), F.col("ma").alias("a")))).alias("k")).select(*entity, "event", "start", "k.*")
    record = months.select(*entity, F.col(severity).alias("_s"), F.col(area).alias("_a"))
    below = lambda c, k: F.sum((F.col(c) <= F.col(k)).cast("long")) / (F.count("*") + 1)
    placed = kinds.join(record, entity).groupBy(*entity, "event", "start", "kind", "s", "a").agg(below("_s", "s").alias("u"), below("_a", "a").alias("v"))
    power = lambda c: F.pow(-F.log(F.col(c)), F.lit(theta))
    both = F.greatest(F.lit(0.0), 1 - F.col("u") - F.col("v") + F.exp(-F.pow(power("u") + power("v"), F.lit(1 / theta))))
    return placed.join(mu, entity).withColumn("p_both", both).withColumn("joint_years", F.when(both > 0, F.col("mu") / (12 * both)))


def availability(data: DataFrame, station: str, kind: str, year: Column, kinds: tuple[str, ...]) -> DataFrame:
    """First and last year of each kind of data by station, one row per station."""
    rows = data.filter(F.col(kind).isin(*kinds)).groupBy(station)
    return rows.agg(*[f(F.when(F.col(kind) == k, year)).alias(f"{k.lower()}_{n}") for k in kinds for n, f in (("start", F.min), ("end", F.max))])


def screened_stations(stations: DataFrame, data: DataFrame, station: str, kind: str, year: Column, kinds: tuple[str, str], prefix: str, upstream: list, downstream: list, least_years: int, covers: tuple[int, int]) -> DataFrame:
    """Stations by prefix with enough years and full coverage of the focus years, and their place about the dam."""
    a, b = (k.lower() for k in kinds)
    found = stations.filter(F.col(station).startswith(prefix)).join(availability(data, station, kind, year, kinds), station)
    start, end = F.least(f"{a}_start", f"{b}_start"), F.greatest(f"{a}_end", f"{b}_end")
    place = F.when(F.col(station).isin(*upstream), "upstream").when(F.col(station).isin(*downstream), "downstream").otherwise("unaffected")
    out = found.withColumns({"rec_start": start, "rec_end": end, "n_years": end - start + 1, "place": place})
    return out.filter((F.col("n_years") >= least_years) & (F.col("rec_start") <= covers[0]) & (F.col("rec_end") >= covers[1]))


def regulation(lat: Column, lon: Column, elevation: Column, dam: tuple[float, float], near: float, zone: tuple[float, float, float, float], least_elevation: float, below: tuple[float, float, float, float]) -> Column:
    """How a dam acts on a lake: the reservoir itself, within its zone, downstream, or not at all. Boxes are lat, lat, lon, lon."""
    box = lambda b: lat.between(b[0], b[1]) & lon.between(b[2], b[3])
    itself = (F.abs(lat - dam[0]) <= near) & (F.abs(lon - dam[1]) <= near)
    inside = box(zone) & (elevation.isNull() | (elevation >= least_elevation))
    return F.when(itself, "impounded").when(inside, "likely impounded").when(box(below) & ~box(zone), "downstream").otherwise("natural")
