"""Queries on regimes of a regression, drivers of events, paired detrending and Kendall curves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from xeric.operators import curves as C
from xeric.operators import events as E
from xeric.operators import series as S
from xeric.operators import trend as T

from .base import INDEX, SITE_MONTHS, index_months, index_values, query, site_months
from .event_queries import _PAIR, SITE, _events_sql, _pairs, r6

_BRIDGE = "list_sum(list_transform(range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * i * i * x * x)))"


@query("ols_cusum", f"""WITH {SITE_MONTHS}, {_PAIR}, a AS (SELECT site, month, y, x - regr_slope(x, y) OVER s * (y - avg(y) OVER s) - avg(x) OVER s AS ex, w - regr_slope(w, y) OVER s * (y - avg(y) OVER s) - avg(w) OVER s AS ew, x FROM pr WINDOW s AS (PARTITION BY site)),
  r AS (SELECT site, month, ex - regr_slope(ex, ew) OVER (PARTITION BY site) * ew AS e FROM a), c AS (SELECT site, month, e, abs(sum(e) OVER (PARTITION BY site ORDER BY month)) AS run FROM r),
  g AS (SELECT site, count(*) AS n, max(run) / sqrt(sum(e * e) / (count(*) - 3) * count(*)) AS x, max_by(month, run) AS at_month FROM c GROUP BY site HAVING count(*) >= 10)
  SELECT site, n, round(x + 1e-9, 6) AS statistic, round(CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0, least(1, {_BRIDGE})) END + 1e-9, 6) AS p, at_month AS change_at FROM g""")  # fmt: skip
def ols_cusum(spark, sf):
    """A site's months regressed on its two neighbours'."""
    d = T.ols_cusum(_pairs(spark, sf), SITE, "x", ["y", "w"])
    return r6(d.withColumns({"statistic": F.col("statistic") + 1e-9, "p": F.col("p") + 1e-9}), "statistic", "p")


@query("supply_drivers", f"""WITH {INDEX}, {_events_sql('idx', -1.0, -1.0, closed=True)},
  sc AS (SELECT site, month, (value - avg(value) OVER s) / nullif(stddev_samp(value) OVER s, 0) AS s FROM sm WINDOW s AS (PARTITION BY site)),
  m AS (SELECT ev.site, ev.event, ev.start, min(o.s) AS a, min(u.s) AS b, min(f.s) AS c FROM ev JOIN idx i ON i.site = ev.site AND i.month BETWEEN ev.start AND ev.finish
    LEFT JOIN sc o ON o.site = i.site AND o.month = i.month LEFT JOIN sc u ON u.site = (i.site + 1) % 25 AND u.month = i.month LEFT JOIN sc f ON f.site = (i.site + 2) % 25 AND f.month = i.month GROUP BY 1, 2, 3)
  SELECT site, start, round(a, 6) AS least_own, round(b, 6) AS least_upper, round(c, 6) AS least_lower,
    CASE WHEN a = least(a, b, c) THEN 'Naturalized streamflow deficit' WHEN b = least(a, b, c) THEN 'Precipitation deficit' WHEN c = least(a, b, c) THEN 'Snowpack deficit' ELSE 'Unknown' END AS primary_driver FROM m""")  # fmt: skip
def supply_drivers(spark, sf):
    """The site's own standard score and those of its two neighbours stand for the components of the supply index."""
    w = Window.partitionBy("site")
    score = F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w))
    scores = site_months(spark, sf).select("site", "month", score.alias("s"))
    idx = index_months(spark, sf)
    events = E.detect_events(idx, SITE, -1.0, closed_onset=True, value="z")
    months = idx
    for name, shift in (("own", 0), ("upper", 1), ("lower", 2)):
        months = months.join(scores.select(((F.col("site") + 25 - shift) % 25).alias("site"), "month", F.col("s").alias(name)), ["site", "month"], "left")
    names = {"own": "Naturalized streamflow deficit", "upper": "Precipitation deficit", "lower": "Snowpack deficit"}
    d = E.primary_driver(months, events, SITE, names).join(events.select("site", "event", "start"), ["site", "event"]).drop("event")
    return r6(d, "least_own", "least_upper", "least_lower")


@query("detrended_pair", f"""WITH {SITE_MONTHS}, {_PAIR}, f AS (SELECT site, month(month) AS m, count(*) AS k, coalesce(CASE WHEN regr_sxx(x, year(month)) > 0 THEN regr_slope(x, year(month)) END, 0) AS bx,
    coalesce(CASE WHEN regr_sxx(y, year(month)) > 0 THEN regr_slope(y, year(month)) END, 0) AS bd, avg(year(month)) AS mean FROM pr GROUP BY 1, 2),
  d AS (SELECT pr.site, month, CASE WHEN k >= 5 THEN x - bx * (year(month) - mean) END AS x, CASE WHEN k >= 5 THEN y - bd * (year(month) - mean) END AS y FROM pr JOIN f ON f.site = pr.site AND f.m = month(month))
  SELECT site, month, round(x, 6) AS x_detrended, round(CASE WHEN y IS NOT NULL THEN least(x, y) END, 6) AS y_detrended FROM d""")  # fmt: skip
def detrended_pair(spark, sf):
    d = S.detrend_pair(_pairs(spark, sf), SITE, "x", "y", least=5)
    return r6(d.select("site", "month", "x_detrended", "y_detrended"), "x_detrended", "y_detrended")


@query("kendall_curves", f"""WITH RECURSIVE {INDEX}, {_events_sql('idv', -0.5, -0.5)}, ar AS (SELECT month, 100 * avg(CASE WHEN z < -0.5 THEN 1.0 ELSE 0.0 END) AS area FROM idv GROUP BY 1),
  gp AS (SELECT site, avg(g) AS gap, stddev_samp(g) AS sd FROM (SELECT site, date_diff('month', lag(start) OVER (PARTITION BY site ORDER BY start), start) AS g FROM ev) GROUP BY 1 HAVING avg(g) > 0),
  ac AS (SELECT site, month, -z AS s, area AS a, row_number() OVER (PARTITION BY site ORDER BY -z) - 1 AS i FROM idv JOIN ar USING (month) WHERE z < 0 AND area > 0),
  ta AS (SELECT p.site, sum(CASE WHEN q.s > p.s THEN sign(q.a - p.a) ELSE 0 END) AS agreed FROM ac p JOIN ac q USING (site) GROUP BY 1),
  mo AS (SELECT site, count(*) AS n, avg(s) AS l1, 2 * sum(i * s) / (count(*) * (count(*) - 1)) - avg(s) AS l2 FROM ac GROUP BY 1 HAVING count(*) >= 10),
  pa AS (SELECT site, n, agreed / (n * (n - 1) / 2) AS tau, -ln(2) / ln(1 - l2 / l1) AS shape, l1, gap, sd / gap AS cv FROM mo JOIN ta USING (site) JOIN gp USING (site) WHERE l2 > 0 AND l2 < l1 AND agreed > 0),
  pb AS (SELECT *, l1 / gamma(1 + 1 / shape) AS scale, 1 / (1 - tau) AS theta, 1 / (cv * cv) AS k, y.years FROM pa, (SELECT unnest([10.0, 25.0, 50.0, 100.0])::DOUBLE AS years) y WHERE tau < 1),
  pc AS (SELECT *, k / (gap / 12) * years AS x FROM pb),
  pd AS (SELECT *, CASE WHEN cv IS NULL OR cv <= 0 OR cv BETWEEN 0.5 AND 1.5 THEN 1 - gap / (years * 12) ELSE greatest(1e-9, least(1 - 1e-9, 1 - (CASE WHEN x > k + 60 * sqrt(k) + 100 THEN 1.0 ELSE
    list_sum(list_transform(range(0, 1500), lambda j: exp((k + j) * ln(x) - x - lgamma(k + j + 1)))) END) / years / 12)) END AS target FROM pc),
  bs(site, years, target, theta, low, high, step) AS (SELECT site, years, target, theta, 1e-8::DOUBLE, (1 - 1e-8)::DOUBLE, 0 FROM pd WHERE target > 0 AND target < 1 UNION ALL
    SELECT site, years, target, theta, CASE WHEN (low + high) / 2 - (low + high) / 2 * ln((low + high) / 2) / theta < target THEN (low + high) / 2 ELSE low END,
      CASE WHEN (low + high) / 2 - (low + high) / 2 * ln((low + high) / 2) / theta < target THEN high ELSE (low + high) / 2 END, step + 1 FROM bs WHERE step < 60),
  lv AS (SELECT site, years, (low + high) / 2 AS level FROM bs WHERE step = 60),
  sh AS (SELECT site, area_pct, greatest(0.5 / (count(*) + 1), least(count(*) / (count(*) + 1), count(*) FILTER (a <= area_pct) / (count(*) + 1))) AS v FROM ac, (SELECT unnest(range(5, 100, 5))::DOUBLE AS area_pct) GROUP BY 1, 2),
  uu AS (SELECT pd.site, pd.years, sh.area_pct, tau, scale, shape, theta, pow(-ln(level), theta) - pow(-ln(v), theta) AS rest FROM pd JOIN lv ON lv.site = pd.site AND lv.years = pd.years JOIN sh ON sh.site = pd.site)
  SELECT site, years, area_pct, round(tau, 6) AS tau, round(CASE WHEN rest > 0 AND exp(-pow(rest, 1 / theta)) < 1 THEN scale * pow(-ln(1 - exp(-pow(rest, 1 / theta))), 1 / shape) END, 5) AS severity FROM uu""")  # fmt: skip
def kendall_curves(spark, sf):
    idx = index_values(spark, sf)
    area = idx.groupBy("month").agg((100 * F.avg((F.col("z") < -0.5).cast("double"))).alias("area"))
    d = C.kendall_curves(idx.join(area, "month").select("site", "month", "z", "area"), SITE)
    return d.select("site", "years", "area_pct", F.round("tau", 6).alias("tau"), F.round("severity", 5).alias("severity"))
