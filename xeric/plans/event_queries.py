"""Queries on events, trends, return periods, association and physical functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from xeric.functions import labels as L
from xeric.operators import association as A
from xeric.operators import events as E
from xeric.operators import frequency as Q
from xeric.operators import physical as H
from xeric.operators import trend as T
from xeric.operators.ordered import exact_quantiles
from xeric.operators.ordered import false_discovery as false_discovery_of
from xeric.sources.scratch import written

from .base import GAPPED, INDEX, SITE_MONTHS, WEIGHTS, gapped, index_months, index_values, query, site_months, site_weights, table

SITE = ["site"]


def _events_sql(source: str, onset: float, end: float, drop: bool = False, least: int = 1, closed: bool = False) -> str:
    """CTEs up to ev: the events of z in ``source``."""
    begins = f"z <= {onset}" if closed else f"z < {onset}"
    over = f"z > {onset}" if closed else f"z >= {end}"
    where = "WHERE z IS NOT NULL" if drop else ""
    return f"""st AS (SELECT site, month, z, coalesce(last_value(CASE WHEN {begins} THEN 1 WHEN {over} THEN 0 END IGNORE NULLS) OVER w, 0) AS s
        FROM {source} {where} WINDOW w AS (PARTITION BY site ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      bg AS (SELECT *, CASE WHEN s = 1 AND coalesce(lag(s) OVER (PARTITION BY site ORDER BY month), 0) = 0 THEN 1 ELSE 0 END AS b FROM st),
      rn AS (SELECT *, sum(b) OVER (PARTITION BY site ORDER BY month) AS event FROM bg),
      ev AS (SELECT site, event, min(month) AS start, max(month) AS finish, count(*) AS duration, min(z) AS minimum, avg(z) AS mean_value, avg({end} - z) AS deficit,
        avg({end} - z) * count(*) AS severity, sum(abs(z)) AS abs_sum, avg(abs(least(z, 0.0))) AS neg_mean FROM rn WHERE s = 1 GROUP BY 1, 2 HAVING count(*) >= {least})"""


def r6(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


@query("drought_events", f"""WITH {INDEX}, {_events_sql('idx', -0.5, -0.5)}
  SELECT site, start, finish, duration, round(minimum, 6) AS minimum, round(severity, 6) AS severity,
  CASE WHEN duration >= 13 THEN 'D13+' WHEN duration >= 7 THEN 'D7-12' WHEN duration >= 3 THEN 'D3-6' ELSE 'sub' END AS class,
  row_number() OVER (PARTITION BY site ORDER BY severity DESC, start) AS rank,
  round((count(*) OVER (PARTITION BY site) + 1.0) / row_number() OVER (PARTITION BY site ORDER BY severity DESC, start), 6) AS return_period FROM ev""")  # fmt: skip
def drought_events(spark, sf):
    e = E.ranked(E.detect_events(index_months(spark, sf), SITE, value="z"), SITE)
    return r6(e.withColumn("class", L.duration_class(F.col("duration"))).select("site", "start", "finish", "duration", "minimum", "severity", "class", "rank", "return_period"), "minimum", "severity", "return_period")


@query("events_hysteresis_keep_nulls", f"""WITH {GAPPED}, {_events_sql('gz', -0.8, -0.2)} SELECT site, start, finish, duration, round(minimum, 6) AS minimum, round(mean_value, 6) AS mean_value,
  CASE WHEN minimum <= -2 THEN 'D3' WHEN minimum <= -1.5 THEN 'D2' ELSE 'D1' END AS class FROM ev""")  # fmt: skip
def events_keep(spark, sf):
    e = E.detect_events(gapped(index_months(spark, sf)), SITE, -0.8, -0.2, value="z")
    return r6(e.select("site", "start", "finish", "duration", "minimum", "mean_value", L.severity_class(F.col("minimum")).alias("class")), "minimum", "mean_value")


@query("event_statistics_drop_nulls", f"""WITH {GAPPED}, {_events_sql('gz', -0.5, -0.5, drop=True, least=2)} SELECT site, count(*) AS n_events, round(avg(duration), 6) AS mean_duration, max(duration) AS max_duration,
  round(avg(severity), 6) AS mean_severity, round(max(severity), 6) AS max_severity, count(*) FILTER (duration BETWEEN 3 AND 6) AS d3_6, count(*) FILTER (duration BETWEEN 7 AND 12) AS d7_12,
  count(*) FILTER (duration >= 13) AS d13_up, count(*) FILTER (duration >= 4) AS d4_up FROM ev GROUP BY site""")  # fmt: skip
def event_statistics(spark, sf):
    e = E.detect_events(gapped(index_months(spark, sf)), SITE, nulls="drop", min_months=2, value="z")
    return r6(E.event_counts(e, SITE), "mean_duration", "mean_severity", "max_severity")


@query("extent_events", f"""WITH {INDEX}, {_events_sql('idx', -0.5, -0.5)} SELECT site, start, duration, round(neg_mean, 6) AS neg_mean FROM ev""")
def extent_events(spark, sf):
    return r6(E.detect_events(index_months(spark, sf), SITE, value="z").select("site", "start", "duration", "neg_mean"), "neg_mean")


@query("composite_index_events", f"""WITH {INDEX}, {_events_sql('idx', -1.0, -1.0, least=3)} SELECT site, start, finish, duration, round(abs_sum, 6) AS severity,
  CASE WHEN minimum <= -2 THEN 'Extreme' WHEN minimum <= -1.5 THEN 'Severe' ELSE 'Moderate' END AS class FROM ev""")  # fmt: skip
def composite_index_events(spark, sf):
    e = E.detect_events(index_months(spark, sf), SITE, -1.0, min_months=3, value="z")
    kind = L.chain([(F.col("minimum") <= -2, "Extreme"), (F.col("minimum") <= -1.5, "Severe")], "Moderate")
    return e.select("site", "start", "finish", "duration", F.round("abs_sum", 6).alias("severity"), kind.alias("class"))


@query("supply_droughts", f"""WITH {INDEX}, {_events_sql('idx', -1.0, -1.0, closed=True)}, m AS (SELECT ev.site, ev.event, ev.start, ev.duration, ev.minimum, ev.mean_value, x.month, x.z FROM ev JOIN idv x ON x.site = ev.site AND x.month BETWEEN ev.start AND ev.finish)
  SELECT site, start, any_value(duration) AS duration, round(any_value(minimum), 6) AS minimum, round(any_value(mean_value), 6) AS mean_value, (array_agg(month ORDER BY z, month))[1] AS driest FROM m GROUP BY site, start""")  # fmt: skip
def supply_droughts(spark, sf):
    idx = index_months(spark, sf)
    e = E.detect_events(idx, SITE, -1.0, closed_onset=True, value="z")
    months = E.months_of_events(idx.filter("z is not null"), e, SITE).groupBy("site", "event").agg(F.min(F.struct("z", "month"))["month"].alias("driest"))
    return r6(e.join(months, ["site", "event"]).select("site", "start", "duration", "minimum", "mean_value", "driest"), "minimum", "mean_value")


@query("flow_droughts", f"""WITH {INDEX}, {_events_sql('idx', -0.84, -0.84)} SELECT ev.site, ev.start, count(*) AS months, round(sum(abs(x.z)) FILTER (x.z < -0.84), 6) AS severity,
  CASE WHEN month(ev.start) IN (12, 1, 2) THEN 'DJF' WHEN month(ev.start) <= 5 THEN 'MAM' WHEN month(ev.start) <= 8 THEN 'JJA' ELSE 'SON' END AS season
  FROM ev JOIN idx x ON x.site = ev.site AND x.month BETWEEN ev.start AND ev.finish GROUP BY ev.site, ev.start""")  # fmt: skip
def flow_droughts(spark, sf):
    idx = index_months(spark, sf)
    m = E.months_of_events(idx, E.detect_events(idx, SITE, -0.84, value="z"), SITE)
    return m.groupBy("site", "start").agg(F.count("*").alias("months"), F.round(F.sum(F.when(F.col("z") < -0.84, F.abs("z"))), 6).alias("severity")).withColumn("season", L.season(F.col("start")))


@query("area_events", f"""WITH {INDEX}, sa AS (SELECT 0 AS site, month, avg(CASE WHEN z < -0.5 THEN 1.0 ELSE 0.0 END) AS area, coalesce(avg(-0.5 - z) FILTER (z < -0.5), 0) AS sev, CASE WHEN coalesce(avg(-0.5 - z) FILTER (z < -0.5), 0) > 0.3 THEN -1.0 ELSE 1.0 END AS z FROM idv GROUP BY month),
  {_events_sql('sa', 0.0, 0.0, least=2)}
  SELECT ev.start, ev.finish, ev.duration, round(avg(x.sev), 6) AS mean_severity, round(max(x.sev), 6) AS max_severity, round(avg(x.area), 6) AS mean_area, round(max(x.area), 6) AS max_area
  FROM ev JOIN sa x ON x.month BETWEEN ev.start AND ev.finish GROUP BY 1, 2, 3""")  # fmt: skip
def area_events(spark, sf):
    dry = F.col("z") < -0.5
    sev = F.coalesce(F.avg(F.when(dry, -0.5 - F.col("z"))), F.lit(0.0))
    sa = index_values(spark, sf).groupBy("month").agg(F.avg(dry.cast("double")).alias("area"), sev.alias("sev")).withColumn("site", F.lit(0))
    sa = sa.withColumn("z", F.when(F.col("sev") > 0.3, -1.0).otherwise(1.0))
    m = E.months_of_events(sa, E.detect_events(sa, SITE, 0.0, min_months=2, value="z").withColumnRenamed("duration", "d").select("site", "event", "start", "finish", "d"), SITE)
    return m.groupBy("start", "finish").agg(F.count("*").alias("duration"), *[F.round(f(c), 6).alias(n) for f, c, n in ((F.avg, "sev", "mean_severity"), (F.max, "sev", "max_severity"), (F.avg, "area", "mean_area"), (F.max, "area", "max_area"))])


@query("drought_months", f"""WITH {GAPPED}, {_events_sql('gz', -1.0, 0.0)} SELECT site, month, s AS in_drought FROM st""")
def drought_months(spark, sf):
    return E.drought_state(gapped(index_months(spark, sf)), SITE, -1.0, 0.0, value="z").select("site", "month", F.col("state").alias("in_drought"))


@query("closing_month_events", f"""WITH {INDEX}, {_events_sql('idx', -1.0, 0.0)}, cl AS (SELECT site, month, z, s, event, coalesce(lag(s) OVER (PARTITION BY site ORDER BY month), 0) AS before FROM rn)
  SELECT site, event, min(month) AS start, max(month) AS finish, count(*) AS duration, round(sum(z), 6) AS severity FROM cl WHERE s = 1 OR before = 1 GROUP BY 1, 2""")  # fmt: skip
def closing_month_events(spark, sf):
    w = Window.partitionBy("site").orderBy("month")
    d = E.drought_state(index_months(spark, sf), SITE, -1.0, 0.0, value="z")
    d = d.withColumn("before", F.coalesce(F.lag("state").over(w), F.lit(0))).withColumn("b", ((F.col("state") == 1) & (F.col("before") == 0)).cast("int"))
    d = d.withColumn("event", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("state = 1 or before = 1")
    return d.groupBy("site", "event").agg(F.min("month").alias("start"), F.max("month").alias("finish"), F.count("*").alias("duration"), F.round(F.sum("z"), 6).alias("severity"))


@query("event_counts", f"""WITH {GAPPED}, f AS (SELECT site, month, coalesce(z < -0.5, false) AS dry FROM gz), b AS (SELECT *, dry AND NOT coalesce(lag(dry) OVER (PARTITION BY site ORDER BY month), false) AS first FROM f)
  SELECT site, count(*) FILTER (first) AS n_events FROM b GROUP BY site""")  # fmt: skip
def event_counts(spark, sf):
    d = gapped(index_months(spark, sf))
    per = E.island_rows(d, SITE, F.col("z") < -0.5).groupBy("site").agg(F.max("event").alias("n_events"))
    return d.select("site").distinct().join(per, "site", "left").select("site", F.coalesce("n_events", F.lit(0)).alias("n_events"))


_ANNUAL = "an AS (SELECT site, year(month) AS t, round(avg(value), 6) AS v FROM sm GROUP BY 1, 2 HAVING count(*) >= 6)"


def _annual(spark, sf):
    return site_months(spark, sf).groupBy("site", F.year("month").alias("t")).agg(F.round(F.avg("value"), 6).alias("v"), F.count("*").alias("n")).filter("n >= 6").drop("n")


@query("mann_kendall", f"""WITH {SITE_MONTHS}, {_ANNUAL}, p AS (SELECT a.site, sum(sign(b.v - a.v)) AS s, quantile_cont((b.v - a.v) / (b.t - a.t), 0.5) AS sen FROM an a JOIN an b ON a.site = b.site AND a.t < b.t GROUP BY 1),
  c AS (SELECT site, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS tied FROM (SELECT site, v, count(*) AS c FROM an GROUP BY 1, 2) GROUP BY 1)
  SELECT site, n, s, round(s / (n * (n - 1) / 2), 6) AS tau, round((n * (n - 1) * (2 * n + 5) - tied) / 18.0, 6) AS variance, round(s / sqrt((n * (n - 1) * (2 * n + 5) - tied) / 18.0), 6) AS z, round(sen, 6) AS sen FROM p JOIN c USING (site)""")  # fmt: skip
def mann_kendall(spark, sf):
    return r6(T.mann_kendall(_annual(spark, sf), SITE), "tau", "variance", "z", "sen")


@query("runs_test", f"""WITH {INDEX}, f AS (SELECT site, month, CASE WHEN z < 0 THEN 1 ELSE 0 END AS flag FROM idv), d AS (SELECT *, CASE WHEN lag(flag) OVER (PARTITION BY site ORDER BY month) = flag THEN 0 ELSE 1 END AS new FROM f),
  g AS (SELECT site, CAST(sum(flag) AS DOUBLE) AS n1, CAST(sum(1 - flag) AS DOUBLE) AS n0, CAST(sum(new) AS DOUBLE) AS runs FROM d GROUP BY 1),
  m AS (SELECT *, 2 * n0 * n1 / (n0 + n1) + 1 AS expected, 2 * n0 * n1 * (2 * n0 * n1 - n0 - n1) / ((n0 + n1) * (n0 + n1) * (n0 + n1 - 1)) AS v FROM g)
  SELECT site, n0, n1, runs, round(expected, 6) AS expected, round((runs - expected) / sqrt(v), 6) AS z, CASE WHEN (runs - expected) / sqrt(v) < -1.96 THEN 'clustered' WHEN (runs - expected) / sqrt(v) > 1.96 THEN 'dispersed' ELSE 'random' END AS kind FROM m""")  # fmt: skip
def runs_test(spark, sf):
    d = index_values(spark, sf).withColumn("flag", (F.col("z") < 0).cast("int"))
    return r6(T.runs_test(d, SITE), "expected", "z")


@query("false_discovery", f"""WITH {SITE_MONTHS}, g AS (SELECT site, month(month) AS m, round(least(1.0, 0.001 + abs(regr_slope(value, year(month))) / 1000), 9) AS p FROM sm GROUP BY 1, 2),
  r AS (SELECT *, count(p) OVER (PARTITION BY m) AS n, row_number() OVER (PARTITION BY m ORDER BY p NULLS LAST, site) AS k FROM g)
  SELECT site, m, p, CASE WHEN p IS NOT NULL THEN round(least(1.0, min(p * n / k) OVER (PARTITION BY m ORDER BY k DESC)), 6) END AS p_adjusted FROM r""")  # fmt: skip
def false_discovery(spark, sf):
    g = site_months(spark, sf).groupBy("site", F.month("month").alias("m")).agg(F.round(F.least(F.lit(1.0), 0.001 + F.abs(F.regr_slope("value", F.year("month").cast("double"))) / 1000), 9).alias("p"))
    return r6(false_discovery_of(written(g, "slopes"), ["m"], "p"), "p_adjusted").select("site", "m", "p", "p_adjusted")


@query("false_discovery_all", f"""WITH {SITE_MONTHS}, g AS (SELECT site, year(month) AS y, month(month) AS m, round(least(1.0, 0.0005000001 + value / 20000), 6) AS p FROM sm),
  r AS (SELECT *, count(p) OVER () AS n, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k FROM g WHERE p IS NOT NULL)
  SELECT site, y, m, p, round(least(1.0, min(p * n / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) + 1e-9, 6) AS p_adjusted FROM r""")  # fmt: skip
def false_discovery_all(spark, sf):
    """One adjustment over all sites and months, with many equal p, in no task alone."""
    p = F.round(F.least(F.lit(1.0), 0.0005000001 + F.col("value") / 20000), 6)
    g = site_months(spark, sf).select("site", F.year("month").alias("y"), F.month("month").alias("m"), p.alias("p"))
    d = false_discovery_of(written(g, "p-values"), [], "p")
    return r6(d.withColumn("p_adjusted", F.col("p_adjusted") + 1e-9), "p_adjusted")


@query("global_quantiles", """WITH v AS (SELECT l_extendedprice AS v FROM lineitem) SELECT p, round(CASE p WHEN 0.0 THEN quantile_cont(v, 0.0) WHEN 0.05 THEN quantile_cont(v, 0.05)
  WHEN 0.5 THEN quantile_cont(v, 0.5) WHEN 0.98 THEN quantile_cont(v, 0.98) ELSE quantile_cont(v, 1.0) END, 6) AS value FROM v, (SELECT unnest([0.0, 0.05, 0.5, 0.98, 1.0])::DOUBLE AS p) GROUP BY p""")
def global_quantiles(spark, sf):
    """Quantiles over every line item, by counted ranges."""
    probs = [0.0, 0.05, 0.5, 0.98, 1.0]
    q = exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", probs)
    listed = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("p"), F.col("quantiles").alias("value"))
    return q.select(F.explode(listed).alias("r")).select(F.col("r.p").alias("p"), F.round("r.value", 6).alias("value"))


@query("group_quantiles", """SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(quantile_cont(l_quantity, 0.25), 6) AS lower, round(quantile_cont(l_quantity, 0.9), 6) AS upper
  FROM lineitem GROUP BY 1, 2""")
def group_quantiles(spark, sf):
    q = exact_quantiles(table(spark, sf, "lineitem"), "l_quantity", [0.25, 0.9], ["l_returnflag", "l_linestatus"])
    return q.select("l_returnflag", "l_linestatus", "n", F.round(F.col("quantiles")[0], 6).alias("lower"), F.round(F.col("quantiles")[1], 6).alias("upper"))


@query("pettitt", f"""WITH {SITE_MONTHS}, r AS (SELECT site, month, rank() OVER (PARTITION BY site ORDER BY value) + (count(*) OVER (PARTITION BY site, value) - 1) / 2.0 AS rk FROM sm),
  u AS (SELECT site, month, count(*) OVER (PARTITION BY site) AS n, row_number() OVER w AS i, 2 * sum(rk) OVER w - row_number() OVER w * (count(*) OVER (PARTITION BY site) + 1) AS u FROM r WINDOW w AS (PARTITION BY site ORDER BY month ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY site ORDER BY abs(u) DESC, i) = 1)
  SELECT site, month AS change_at, abs(u) AS k, round(least(1.0, 2 * exp(-6.0 * u * u / (n * n * n + n * n))), 6) AS p FROM b""")  # fmt: skip
def pettitt(spark, sf):
    return r6(T.pettitt(site_months(spark, sf), SITE, "month", "value"), "p")


@query("linear_trend", f"""WITH {SITE_MONTHS}, {_ANNUAL} SELECT site, regr_count(v, t) AS n, round(regr_slope(v, t) + 1e-9, 6) AS slope, round(regr_r2(v, t), 6) AS r2,
  round(sqrt(greatest(0, regr_syy(v, t) * (1 - regr_r2(v, t)) / ((regr_count(v, t) - 2) * regr_sxx(v, t)))), 6) AS slope_se FROM an GROUP BY site HAVING count(*) > 2""")  # fmt: skip
def linear_trend(spark, sf):
    d = _annual(spark, sf).withColumn("t", F.col("t").cast("double"))
    fit = T.linear_trend(d, SITE, "t", "v").withColumn("slope", F.col("slope") + 1e-9)
    return r6(fit.filter("n > 2").select("site", "n", "slope", "r2", "slope_se"), "slope", "r2", "slope_se")


@query("chow_test", f"""WITH {SITE_MONTHS}, x AS (SELECT site, date_diff('month', DATE '1995-01-01', month) * 1.0 AS t, value AS v FROM sm),
  one AS (SELECT site, regr_syy(v, t) * (1 - coalesce(regr_r2(v, t), 0)) AS one, count(*) AS n FROM x GROUP BY 1), two AS (SELECT site, sum(r) AS two, count(*) AS k FROM (SELECT site, t < 36 AS side, regr_syy(v, t) * (1 - coalesce(regr_r2(v, t), 0)) AS r FROM x GROUP BY 1, 2) GROUP BY 1)
  SELECT site, n, round((one - two) / 2 / (two / (n - 4)), 6) AS f FROM one JOIN two USING (site) WHERE k = 2""")  # fmt: skip
def chow_test(spark, sf):
    d = site_months(spark, sf).withColumn("t", F.bround(F.months_between("month", F.lit("1995-01-01").cast("date"))))
    return r6(T.chow(d, SITE, "t", "value", F.col("t") < 36), "f")


@query("detrended_months", f"""WITH {SITE_MONTHS}, f AS (SELECT site, month(month) AS m, CASE WHEN regr_sxx(value, year(month)) > 0 THEN regr_slope(value, year(month)) ELSE 0 END AS b, avg(year(month)) AS y FROM sm GROUP BY 1, 2)
  SELECT sm.site, sm.month, round(value - b * (year(sm.month) - y), 6) AS detrended FROM sm JOIN f ON f.site = sm.site AND f.m = month(sm.month)""")  # fmt: skip
def detrended_months(spark, sf):
    from xeric.operators.series import detrend_by_month

    return r6(detrend_by_month(site_months(spark, sf), SITE).select("site", "month", "detrended"), "detrended")


@query("class_return_periods", f"""WITH {INDEX}, {_events_sql('idx', -0.5, -0.5)}, y AS (SELECT site, count(DISTINCT year(month)) AS years FROM idx GROUP BY 1), k AS (SELECT ev.site, years, CASE WHEN duration >= 13 THEN 'D13+' WHEN duration >= 7 THEN 'D7-12' WHEN duration >= 3 THEN 'D3-6' ELSE 'D1-2' END AS class FROM ev JOIN y USING (site))
  SELECT site, class, count(*) AS n, round(any_value(years) * 1.0 / count(*), 6) AS return_period FROM k GROUP BY 1, 2""")  # fmt: skip
def class_return_periods(spark, sf):
    idx = index_months(spark, sf)
    years = idx.groupBy("site").agg(F.countDistinct(F.year("month")).alias("years"))
    e = E.detect_events(idx, SITE, value="z").withColumn("class", L.duration_class(F.col("duration"), 1)).join(years, "site")
    return r6(Q.class_return_periods(e, SITE, "class", F.col("years")), "return_period")


@query("renewal_statistics", f"""WITH {INDEX}, {_events_sql('idx', -0.5, -0.5)}, i AS (SELECT site, date_diff('month', lag(start) OVER (PARTITION BY site ORDER BY start), start) AS iat FROM ev)
  SELECT site, count(iat) AS n, round(avg(iat), 6) AS mean_iat, round(stddev_samp(iat) / avg(iat), 6) AS cv, round(1 / ((stddev_samp(iat) / avg(iat)) * (stddev_samp(iat) / avg(iat))), 4) AS shape,
  stddev_samp(iat) / avg(iat) > 0.5 AND stddev_samp(iat) / avg(iat) < 1.5 AS poisson FROM i GROUP BY site""")  # fmt: skip
def renewal_statistics(spark, sf):
    out = Q.renewal(E.detect_events(index_months(spark, sf), SITE, value="z"), SITE)
    return r6(out, "mean_iat", "cv").withColumn("shape", F.round("shape", 4))


_LM = """rk AS (SELECT site, value AS v, row_number() OVER (PARTITION BY site ORDER BY value) * 1.0 AS i, count(*) OVER (PARTITION BY site) * 1.0 AS n FROM sm),
  b AS (SELECT site, count(*) AS n, avg(v) AS b0, avg(v * (i - 1) / (n - 1)) AS b1, avg(v * (i - 1) / (n - 1) * (i - 2) / (n - 2)) AS b2, avg(v * (i - 1) / (n - 1) * (i - 2) / (n - 2) * (i - 3) / (n - 3)) AS b3 FROM rk GROUP BY site),
  lm AS (SELECT site, n, b0 AS l1, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3, (20 * b3 - 30 * b2 + 12 * b1 - b0) / (2 * b1 - b0) AS t4 FROM b)"""


@query("l_moments", f"WITH {SITE_MONTHS}, {_LM} SELECT site, n, round(l1 + 1e-9, 5) AS l1, round(l2, 5) AS l2, round(t3, 6) AS t3, round(t4, 6) AS t4 FROM lm")
def l_moments(spark, sf):
    d = Q.l_moments(site_months(spark, sf), SITE)
    return r6(d, "t3", "t4").withColumns({"l1": F.round(F.col("l1") + 1e-9, 5), "l2": F.round("l2", 5)})


@query("regional_l_moments", f"""WITH {SITE_MONTHS}, {_LM}, r AS (SELECT site % 5 AS region, *, l2 / l1 AS t, sum(n * l2 / l1) OVER (PARTITION BY site % 5) / sum(n) OVER (PARTITION BY site % 5) AS m FROM lm)
  SELECT region, count(*) AS n_sites, round(sum(n * t) / sum(n), 6) AS t, round(sum(n * t3) / sum(n), 6) AS t3, round(sum(n * t4) / sum(n), 6) AS t4, round(sqrt(sum(n * (t - m) * (t - m)) / sum(n)), 6) AS spread FROM r GROUP BY region""")  # fmt: skip
def regional_l_moments(spark, sf):
    d = Q.l_moments(site_months(spark, sf), SITE).withColumn("region", F.col("site") % 5)
    return r6(Q.regional_l_moments(d, ["region"]), "t", "t3", "t4", "spread")


_PAIR = "pr AS (SELECT a.month, a.site, a.value AS x, b.value AS y, c.value AS w FROM sm a JOIN sm b ON a.month = b.month AND b.site = (a.site + 1) % 25 JOIN sm c ON a.month = c.month AND c.site = (a.site + 2) % 25)"


def _pairs(spark, sf):
    sm = site_months(spark, sf)
    b = sm.select(((F.col("site") + 24) % 25).alias("site"), "month", F.col("value").alias("y"))
    c = sm.select(((F.col("site") + 23) % 25).alias("site"), "month", F.col("value").alias("w"))
    return sm.withColumnRenamed("value", "x").join(b, ["site", "month"]).join(c, ["site", "month"])


_U = """ps AS (SELECT site, month, (rank() OVER (PARTITION BY site ORDER BY x) + (count(*) OVER (PARTITION BY site, x) - 1) / 2.0) / (count(*) OVER (PARTITION BY site) + 1) AS u,
  (rank() OVER (PARTITION BY site ORDER BY y) + (count(*) OVER (PARTITION BY site, y) - 1) / 2.0) / (count(*) OVER (PARTITION BY site) + 1) AS v FROM pr)"""


@query("pseudo_observations", f"WITH {SITE_MONTHS}, {_PAIR}, {_U} SELECT site, month, round(u, 6) AS u, round(v, 6) AS v FROM ps")
def pseudo_observations(spark, sf):
    d = Q.pseudo_observations(_pairs(spark, sf), SITE, ["x", "y"])
    return d.select("site", "month", F.round("u_x", 6).alias("u"), F.round("u_y", 6).alias("v"))


@query("tail_dependence", f"WITH {SITE_MONTHS}, {_PAIR}, {_U} SELECT site, count(*) AS n, round(count(*) FILTER (u <= 0.1 AND v <= 0.1) * 1.0 / nullif(count(*) FILTER (u <= 0.1), 0), 6) AS lambda_low FROM ps GROUP BY site")
def tail_dependence(spark, sf):
    d = Q.pseudo_observations(_pairs(spark, sf), SITE, ["x", "y"])
    return r6(Q.tail_dependence(d, SITE, "u_x", "u_y", 0.1), "lambda_low")


@query("upper_tail_cfg", f"WITH {SITE_MONTHS}, {_PAIR}, {_U} SELECT site, count(*) AS n, round(2 - 2 * exp(avg(ln(sqrt(ln(1 / u) * ln(1 / v)) / ln(1 / (greatest(u, v) * greatest(u, v)))))), 6) AS lambda_up FROM ps GROUP BY site")
def upper_tail_cfg(spark, sf):
    d = Q.pseudo_observations(_pairs(spark, sf), SITE, ["x", "y"])
    return r6(Q.upper_tail_cfg(d, SITE, "u_x", "u_y"), "lambda_up")


@query("tie_diagnostics", f"WITH {SITE_MONTHS}, {_PAIR}, {_U}, q AS (SELECT unnest([0.9, 0.95, 0.99]) AS q) SELECT site, CAST(q AS DOUBLE) AS q, round(avg(CASE WHEN u > q THEN 1.0 ELSE 0.0 END), 6) AS share, round(1 - q, 6) AS nominal FROM ps, q GROUP BY site, q")
def tie_diagnostics(spark, sf):
    d = Q.pseudo_observations(_pairs(spark, sf), SITE, ["x"])
    return r6(Q.tie_diagnostics(d, SITE, "u_x"), "share", "nominal")


@query("triple_collocation", f"""WITH {SITE_MONTHS}, {_PAIR}, c AS (SELECT site, count(*) AS n, covar_samp(x, x) - covar_samp(x, y) * covar_samp(x, w) / covar_samp(y, w) AS ex, covar_samp(y, y) - covar_samp(x, y) * covar_samp(y, w) / covar_samp(x, w) AS ey, covar_samp(w, w) - covar_samp(x, w) * covar_samp(y, w) / covar_samp(x, y) AS ez FROM pr GROUP BY site)
  SELECT site, n, round(CASE WHEN ex > 0 THEN ex END, 2) AS err_x, round(CASE WHEN ey > 0 THEN ey END, 2) AS err_y, round(CASE WHEN ez > 0 THEN ez END, 2) AS err_z FROM c""")  # fmt: skip
def triple_collocation(spark, sf):
    d = Q.triple_collocation(_pairs(spark, sf), SITE, "x", "y", "w")
    return d.select("site", "n", *[F.round(c, 2).alias(c) for c in ("err_x", "err_y", "err_z")])


_LAGS = "lg AS (SELECT a.site, l AS lag, corr(a.z, b.z) AS r, count(*) AS n FROM idv a, (SELECT unnest(range(0, 13)) AS l) JOIN idv b ON b.site = (a.site + 1) % 25 AND b.month = CAST(a.month - to_months(CAST(l AS INT)) AS DATE) GROUP BY 1, 2 HAVING count(*) >= 20)"


def _lagged(spark, sf):
    idx = index_values(spark, sf)
    a = idx.select("site", "month", F.col("z").alias("y"))
    b = idx.select(((F.col("site") + 24) % 25).alias("site"), "month", F.col("z").alias("x"))
    return A.lagged_correlation(a, b, SITE)


@query("lagged_correlation", f"WITH {INDEX}, {_LAGS} SELECT site, lag, round(r, 6) AS r, n FROM lg")
def lagged_correlation(spark, sf):
    return r6(_lagged(spark, sf), "r")


@query("best_lag", f"WITH {INDEX}, {_LAGS} SELECT site, lag, round(r, 6) AS r, n FROM lg QUALIFY row_number() OVER (PARTITION BY site ORDER BY round(abs(r), 9) DESC, lag) = 1")
def best_lag(spark, sf):
    return r6(A.best_lag(_lagged(spark, sf), SITE), "r")


_XY = "xy AS (SELECT a.site, a.month, a.z AS y, b.z AS x FROM idx a JOIN idx b ON a.month = b.month AND b.site = (a.site + 1) % 25)"


def _xy(spark, sf):
    idx = index_months(spark, sf)
    return idx.select("site", "month", F.col("z").alias("y")).join(idx.select(((F.col("site") + 24) % 25).alias("site"), "month", F.col("z").alias("x")), ["site", "month"])


@query("effective_correlation", f"""WITH {INDEX}, {_XY}, l AS (SELECT *, lag(x) OVER w AS x1, lag(y) OVER w AS y1 FROM xy WINDOW w AS (PARTITION BY site ORDER BY month)),
  g AS (SELECT site, corr(y, x) AS r, count(*) AS n, (corr(x, x1) + corr(y, y1)) / 2 AS r1 FROM l GROUP BY site), e AS (SELECT *, greatest(3, round_even(n * (1 - r1) / nullif(1 + r1, 0), 0)) AS n_eff FROM g)
  SELECT site, n, round(r, 6) AS r, round(r1, 6) AS r1, n_eff, round(r * sqrt((n_eff - 2) / nullif(round(1 - r * r, 12), 0)), 6) AS t FROM e""")  # fmt: skip
def effective_correlation(spark, sf):
    return r6(A.effective_correlation(_xy(spark, sf), SITE), "r", "r1", "t")


@query("leave_year_out_skill", f"""WITH {INDEX}, {_XY}, xyv AS (SELECT * FROM xy WHERE x IS NOT NULL AND y IS NOT NULL), f AS (SELECT o.site, o.yr, regr_slope(i.y, i.x) AS b, regr_intercept(i.y, i.x) AS a FROM (SELECT DISTINCT site, year(month) AS yr FROM xyv) o JOIN xyv i ON i.site = o.site AND year(i.month) <> o.yr GROUP BY 1, 2),
  p AS (SELECT xyv.site, y, a + b * x AS fit FROM xyv JOIN f ON f.site = xyv.site AND f.yr = year(month))
  SELECT site, count(*) AS n, round(corr(y, fit), 5) AS r, round(sqrt(avg((fit - y) * (fit - y))), 6) AS rmse, round(count(*) FILTER (y < -0.5 AND fit < -0.5) * 1.0 / nullif(count(*) FILTER (y < -0.5), 0), 6) AS hit_rate FROM p GROUP BY site""")  # fmt: skip
def leave_year_out_skill(spark, sf):
    out = A.leave_year_out(_xy(spark, sf).dropna(), SITE, dry=-0.5)
    return out.select("site", "n", F.round("r", 5).alias("r"), F.round("rmse", 6).alias("rmse"), F.round("hit_rate", 6).alias("hit_rate"))


@query("composite_months", f"""WITH {INDEX}, e AS (SELECT month, avg(z) < -0.1 AS dry FROM idv GROUP BY 1), j AS (SELECT sm.site, sm.value, dry FROM sm JOIN e USING (month))
  SELECT site, count(*) FILTER (dry) AS n_event, round(avg(value) FILTER (dry) + 1e-9, 4) AS event_mean, round(avg(value) FILTER (NOT dry) + 1e-9, 4) AS other_mean,
  round((avg(value) FILTER (dry) - avg(value) FILTER (NOT dry)) / sqrt(var_samp(value) FILTER (dry) / count(*) FILTER (dry) + var_samp(value) FILTER (NOT dry) / count(*) FILTER (NOT dry)), 6) AS t FROM j GROUP BY site""")  # fmt: skip
def composite_months(spark, sf):
    e = index_values(spark, sf).groupBy("month").agg((F.avg("z") < -0.1).alias("dry"))
    out = A.composite(site_months(spark, sf).join(e, "month"), SITE, "dry", "value")
    return out.select("site", "n_event", F.round(F.col("event_mean") + 1e-9, 4).alias("event_mean"), F.round(F.col("other_mean") + 1e-9, 4).alias("other_mean"), F.round("t", 6).alias("t"))


@query("pixel_basin_correlation", f"WITH {SITE_MONTHS}, b AS (SELECT month, avg(value) AS basin FROM sm GROUP BY 1) SELECT site, round(corr(value, basin), 6) AS r FROM sm JOIN b USING (month) GROUP BY site")
def pixel_basin_correlation(spark, sf):
    sm = site_months(spark, sf)
    return r6(sm.join(sm.groupBy("month").agg(F.avg("value").alias("basin")), "month").groupBy("site").agg(F.corr("value", "basin").alias("r")), "r")


@query("dynamic_decomposition", f"""WITH {INDEX}, {_XY} SELECT site, month, round(y - x, 6) AS dynamic, CASE WHEN y <= -0.5 THEN round(x / y, 6) END AS thm_frac, CASE WHEN y <= -0.5 THEN round((y - x) / y, 6) END AS dyn_frac FROM xy""")
def dynamic_decomposition(spark, sf):
    return r6(A.decomposition(_xy(spark, sf), "y", "x").select("site", "month", "dynamic", "thm_frac", "dyn_frac"), "dynamic", "thm_frac", "dyn_frac")


@query("bias_by_period", f"""WITH {SITE_MONTHS}, {_PAIR}, d AS (SELECT site, year(month) < 1998 AS early, x - y AS bias FROM pr)
  SELECT site, round(avg(bias) FILTER (early) + 1e-9, 4) AS early_bias, round(avg(bias) FILTER (NOT early) + 1e-9, 4) AS late_bias, round((avg(bias) FILTER (NOT early) - avg(bias) FILTER (early)) / stddev_samp(bias), 6) AS shift FROM d GROUP BY site""")  # fmt: skip
def bias_by_period(spark, sf):
    d = _pairs(spark, sf).select("site", (F.year("month") < 1998).alias("early"), (F.col("x") - F.col("y")).alias("bias"))
    a, b = F.avg(F.when(F.col("early"), F.col("bias"))), F.avg(F.when(~F.col("early"), F.col("bias")))
    return d.groupBy("site").agg(F.round(a + 1e-9, 4).alias("early_bias"), F.round(b + 1e-9, 4).alias("late_bias"), F.round((b - a) / F.stddev_samp("bias"), 6).alias("shift"))


@query("mediation_effects", f"""WITH {SITE_MONTHS}, {_PAIR}, g AS (SELECT site, covar_samp(x, x) AS xx, covar_samp(x, y) AS xm, covar_samp(y, y) AS mm, covar_samp(x, w) AS xy, covar_samp(y, w) AS my FROM pr GROUP BY site)
  SELECT site, round(xm / xx * (my * xx - xy * xm) / (xx * mm - xm * xm), 6) AS indirect, round((xy * mm - my * xm) / (xx * mm - xm * xm), 6) AS direct, round(xy / xx, 6) AS total FROM g""")  # fmt: skip
def mediation_effects(spark, sf):
    return r6(A.mediation(_pairs(spark, sf), SITE, "x", "y", "w").select("site", "indirect", "direct", "total"), "indirect", "direct", "total")


@query("active_storage", f"WITH {SITE_MONTHS} SELECT site, month, greatest(0.0, value - 300 - 50.5) AS active FROM sm")
def active_storage(spark, sf):
    return site_months(spark, sf).select("site", "month", H.active_storage(F.col("value"), F.lit(300), F.lit(50.5)).alias("active"))


@query("water_balance", f"WITH {SITE_MONTHS}, {_PAIR} SELECT site, month, round(x - 0.5 * y, 6) AS balance FROM pr")
def water_balance(spark, sf):
    return _pairs(spark, sf).select("site", "month", F.round(F.col("x") - 0.5 * F.col("y"), 6).alias("balance"))


@query("stage_to_storage", """WITH c AS (SELECT CAST(p_size AS DOUBLE) AS level, sum(p_retailprice) OVER (ORDER BY p_size) AS storage FROM (SELECT p_size, round(avg(p_retailprice) + 1e-7, 4) AS p_retailprice FROM part GROUP BY 1)),
  s AS (SELECT level AS a, storage AS sa, lead(level) OVER (ORDER BY level) AS b, lead(storage) OVER (ORDER BY level) AS sb FROM c), r AS (SELECT l_orderkey, l_linenumber, l_quantity + 0.25 AS stage FROM lineitem)
  SELECT l_orderkey, l_linenumber, stage, round(sa + (stage - a) / (b - a) * (sb - sa) + 1e-7, 4) AS storage FROM r LEFT JOIN s ON b IS NOT NULL AND stage >= a AND stage < b""")  # fmt: skip
def stage_to_storage(spark, sf):
    c = table(spark, sf, "part").groupBy(F.col("p_size").cast("double").alias("level")).agg(F.round(F.avg("p_retailprice") + 1e-7, 4).alias("area"))
    c = c.select("level", F.sum("area").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)).alias("storage"))
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 0.25).alias("stage"))
    return H.stage_storage(r, c).select("l_orderkey", "l_linenumber", "stage", F.round(F.col("storage") + 1e-7, 4).alias("storage"))


@query("hypsometric_volume", """WITH c AS (SELECT p_brand AS lake, CAST(p_size AS DOUBLE) AS e, round(avg(p_retailprice) + 1e-7, 2) AS a FROM part GROUP BY 1, 2), s AS (SELECT lake, e, coalesce((e - lag(e) OVER w) * (a + lag(a) OVER w) / 2, 0) AS v FROM c WINDOW w AS (PARTITION BY lake ORDER BY e))
  SELECT lake, e AS elevation, round(sum(v) OVER (PARTITION BY lake ORDER BY e) + 1e-6, 2) AS volume FROM s""")  # fmt: skip
def hypsometric_volume(spark, sf):
    c = table(spark, sf, "part").groupBy(F.col("p_brand").alias("lake"), F.col("p_size").cast("double").alias("elevation")).agg(F.round(F.avg("p_retailprice") + 1e-7, 2).alias("area"))
    return H.hypsometric_volume(c, ["lake"]).select("lake", "elevation", F.round(F.col("volume") + 1e-6, 2).alias("volume"))


_CLIMATE = "cl AS (SELECT site, month, 8 - 15 * cos(2 * pi() * (month(month) - 0.5) / 12) + value / 2000 AS t, 50.0 + site % 5 AS lat FROM sm)"


def _climate(spark, sf):
    t = 8 - 15 * F.cos(2 * F.pi() * (F.month("month") - 0.5) / 12) + F.col("value") / 2000
    return site_months(spark, sf).select("site", "month", t.alias("t"), (50.0 + F.col("site") % 5).alias("lat"))


@query("thornthwaite", f"""WITH {SITE_MONTHS}, {_CLIMATE}, h AS (SELECT site, sum(pow(greatest(t, 0) / 5, 1.514)) AS i FROM (SELECT site, month(month) AS m, avg(t) AS t FROM cl WHERE year(month) BETWEEN 1995 AND 1999 GROUP BY 1, 2) GROUP BY 1),
  d AS (SELECT cl.*, i, 6.75e-7 * i * i * i - 7.71e-5 * i * i + 1.792e-2 * i + 0.49239 AS a, 0.409 * sin(2 * pi() / 365 * dayofyear(CAST(month + INTERVAL 14 DAY AS DATE)) - 1.39) AS decl FROM cl JOIN h USING (site))
  SELECT site, month, CASE WHEN t <= 0 THEN 0.0 ELSE round(16 * (24 / pi() * acos(least(greatest(-tan(radians(lat)) * tan(decl), -1.0), 1.0)) / 12) * (day(last_day(month)) / 30.0) * pow(10 * t / i, a) / day(last_day(month)), 6) END AS pet FROM d""")  # fmt: skip
def thornthwaite(spark, sf):
    return r6(H.thornthwaite(_climate(spark, sf), SITE, first_year=1995, last_year=1999).select("site", "month", "pet"), "pet")


@query("penman_monteith", f"""WITH {SITE_MONTHS}, {_CLIMATE}, v AS (SELECT site, month, t, 0.6108 * exp(17.27 * t / (t + 237.3)) AS es, 0.6108 * exp(17.27 * (t - 4) / (t - 4 + 237.3)) AS ea, t - coalesce(lag(t) OVER (PARTITION BY site ORDER BY month), t) AS dt FROM cl),
  n AS (SELECT *, 4098 * es / ((t + 237.3) * (t + 237.3)) AS sl, 0.000665 * 95.0 AS ga, 2.5 * 4.87 / ln(67.8 * 10 - 5.42) AS u2, 0.77 * 14.0 - 4.903e-9 * pow(t + 273.16, 4) * (0.34 - 0.14 * sqrt(ea)) * least(greatest(1.35 * (14.0 / (0.75 * 26.0)) - 0.35, 0.05), 1.0) AS rn FROM v),
  g AS (SELECT *, CASE WHEN t < 0 THEN least(greatest(0.14 * dt, -0.3 * abs(rn)), 0.3 * abs(rn)) ELSE 0.14 * dt END AS gg FROM n)
  SELECT site, month, round(greatest((0.408 * sl * (rn - gg) + ga * 900 / (t + 273) * u2 * greatest(es - ea, 0)) / (sl + ga * (1 + 0.34 * u2)), 0), 6) AS et0 FROM g""")  # fmt: skip
def penman_monteith(spark, sf):
    d = _climate(spark, sf).withColumns({"tdew": F.col("t") - 4, "wind": F.lit(2.5), "pressure": F.lit(95.0), "rs": F.lit(14.0), "ra": F.lit(26.0)})
    return r6(H.penman_monteith(d, SITE).select("site", "month", "et0"), "et0")


@query("storage_deficit", f"""WITH RECURSIVE {SITE_MONTHS}, d AS (SELECT site, month, row_number() OVER (PARTITION BY site ORDER BY month) AS i, (value - avg(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) * 100 AS tsd FROM sm WINDOW w AS (PARTITION BY site, month(month))),
  r AS (SELECT site, month, i, tsd, 0.02 * tsd AS ix FROM d WHERE i = 1 UNION ALL SELECT d.site, d.month, d.i, d.tsd, CASE WHEN d.tsd IS NULL THEN r.ix WHEN r.ix IS NULL THEN 0.02 * d.tsd ELSE 0.6 * r.ix + 0.02 * d.tsd END FROM r JOIN d ON d.site = r.site AND d.i = r.i + 1)
  SELECT site, month, round(tsd, 6) AS tsd, round(ix, 6) AS index FROM r""")  # fmt: skip
def storage_deficit(spark, sf):
    return r6(H.storage_deficit_index(site_months(spark, sf), SITE, 0.6, 0.02), "tsd", "index")


@query("groundwater_index", f"WITH {SITE_MONTHS}, r AS (SELECT site, month, rank() OVER (PARTITION BY site, month(month) ORDER BY value) + (count(*) OVER (PARTITION BY site, month(month), value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY site, month(month)) AS n FROM sm) SELECT site, month, round((2 * rk - 1) / (2 * n), 6) AS p FROM r WHERE n >= 4")
def groundwater_index(spark, sf):
    from .base import empirical_index

    d = empirical_index(site_months(spark, sf), SITE, "value", least=4, a=0.5).filter("p is not null")
    return d.select("site", "month", F.round("p", 6).alias("p"))


@query("site_weights", f"WITH {WEIGHTS} SELECT site, weight, lat, lon FROM sw")
def weights(spark, sf):
    return site_weights(spark, sf)


@query("joint_return_period", f"""WITH {SITE_MONTHS}, {_PAIR}, {_U} SELECT site, month, round(1 - u - v + exp(-sqrt(ln(u) * ln(u) + ln(v) * ln(v))), 6) AS p_both, round(6.0 / (12 * (1 - u - v + exp(-sqrt(ln(u) * ln(u) + ln(v) * ln(v))))), 4) AS joint_years FROM ps""")
def joint_return_period(spark, sf):
    d = Q.pseudo_observations(_pairs(spark, sf), SITE, ["x", "y"]).withColumn("gap", F.lit(6.0))
    out = Q.joint_return_period(d, "gumbel", 2.0, "u_x", "u_y", "gap")
    return out.select("site", "month", F.round("p_both", 6).alias("p_both"), F.round("joint_years", 4).alias("joint_years"))


@query("shrunk_bias_ratio", f"""WITH {SITE_MONTHS}, {_PAIR}, a AS (SELECT site, median(x / nullif(y, 0)) AS prior FROM pr GROUP BY 1), m AS (SELECT site, month(month) AS cal_month, count(x / nullif(y, 0)) AS n, median(x / nullif(y, 0)) AS m FROM pr GROUP BY 1, 2)
  SELECT site, cal_month, n, round(least(greatest(least(1.0, n / 5.0) * coalesce(m, prior) + (1 - least(1.0, n / 5.0)) * prior, 0.5), 2.0), 6) AS ratio FROM m JOIN a USING (site)""")  # fmt: skip
def shrunk_bias_ratio(spark, sf):
    return r6(Q.shrunk_ratio(_pairs(spark, sf), SITE, "x", "y"), "ratio")


_WEIBULL = "CASE WHEN max({c}) OVER w > min({c}) OVER w THEN least(greatest((rank() OVER (PARTITION BY site, month(month) ORDER BY {c}) + (count(*) OVER (PARTITION BY site, month(month), {c}) - 1) / 2.0) / (count(*) OVER w + 1), 1e-4), 1 - 1e-4) ELSE 0.5 END"


@query("supply_index", f"""WITH {SITE_MONTHS}, {_PAIR}, p AS (SELECT site, month, {_WEIBULL.format(c='x')} AS px, {_WEIBULL.format(c='y')} AS py FROM pr WINDOW w AS (PARTITION BY site, month(month))),
  z AS (SELECT site, month, {L.normal_quantile_sql('px')} AS zx, {L.normal_quantile_sql('py')} AS zy FROM p)
  SELECT site, month, round(least(greatest((0.6 * zx + 0.4 * zy) / (0.6 + 0.4), -4.2), 4.2), 6) AS supply FROM z""")  # fmt: skip
def supply_index(spark, sf):
    from xeric.operators.indices import supply_index as index

    return index(_pairs(spark, sf), SITE, {"x": 0.6, "y": 0.4}).select("site", "month", F.round("supply", 6).alias("supply"))
