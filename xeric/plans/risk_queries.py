"""Queries on bias, placement of events, screening, storage deficits and moving dependence."""

from __future__ import annotations

from pyspark.sql import functions as F

from xeric.functions.labels import normal_quantile, normal_quantile_sql
from xeric.operators import association as A
from xeric.operators import bias as B
from xeric.operators import events as E
from xeric.operators import physical as H
from xeric.operators import placement as P
from xeric.operators import risk as K
from xeric.operators import frequency as Q
from xeric.operators import spatial as S
from xeric.operators.series import average_rank, trailing

from .base import INDEX, SITE_MONTHS, index_months, index_values, query, site_months, spined_months, table
from .event_queries import _PAIR, _U, SITE, _events_sql, _pairs, r6


@query("overlapping_events", f"""WITH {INDEX}, {_events_sql('idx', -0.5, -0.5)}
  SELECT a.site, a.start, a.finish, b.start AS other_start, b.finish AS other_finish FROM ev a JOIN ev b
  ON b.site = (a.site + 1) % 25 AND a.start <= b.finish AND a.finish >= b.start""")  # fmt: skip
def overlapping_events(spark, sf):
    e = E.detect_events(index_months(spark, sf), SITE, value="z").select("site", "start", "finish")
    return P.overlapping(e, e.withColumn("site", (F.col("site") + 24) % 25), SITE).select("site", "start", "finish", "other_start", "other_finish")


@query("class_subset", f"""WITH {INDEX}, {_events_sql('idx', -0.5, -0.5)},
  c AS (SELECT *, CASE WHEN duration >= 13 THEN 'D13+' WHEN duration >= 7 THEN 'D7-12' WHEN duration >= 3 THEN 'D3-6' ELSE 'sub' END AS class FROM ev)
  SELECT site, start, class, round(severity, 6) AS severity FROM c QUALIFY count(*) OVER (PARTITION BY class) >= 15""")  # fmt: skip
def class_subset(spark, sf):
    from xeric.functions.labels import duration_class

    e = E.detect_events(index_months(spark, sf), SITE, value="z").withColumn("class", duration_class(F.col("duration")))
    return r6(P.class_subset(e).select("site", "start", "class", "severity"), "severity")


@query("power_law_storage", f"""WITH {SITE_MONTHS} SELECT site, month,
  round(2.5 * pow(greatest(value - 200, 0.0) / 40, 1.3), 6) AS area, round(2.5 * 40 / 2.3 * pow(greatest(value - 200, 0.0) / 40, 2.3), 5) AS storage FROM sm""")  # fmt: skip
def power_law_storage(spark, sf):
    curve = (2.5, 200.0, 40.0, 1.3)
    v = F.col("value")
    return site_months(spark, sf).select("site", "month", F.round(H.power_law_area(v, *curve), 6).alias("area"), F.round(H.power_law_storage(v, *curve), 5).alias("storage"))


@query("bias_tier", f"""WITH {SITE_MONTHS}, {_PAIR},
  a AS (SELECT site, CASE WHEN count(*) FILTER (x > 0 AND y > 0) >= 3 THEN median(y / x) FILTER (x > 0 AND y > 0) ELSE 1 END AS pr,
    CASE WHEN count(*) >= 3 THEN median(y - x) ELSE 0 END AS pd FROM pr GROUP BY site),
  m AS (SELECT site, month(month) AS cal_month, count(*) AS n, median(y / x) FILTER (x > 0 AND y > 0) AS r, median(y - x) AS d, median(x) AS mid,
    CASE WHEN count(*) >= 3 AND stddev_samp(x) > 1e-8 THEN regr_slope(y, x) END AS b1, CASE WHEN count(*) >= 3 AND stddev_samp(x) > 1e-8 THEN regr_intercept(y, x) END AS b0 FROM pr GROUP BY 1, 2),
  w AS (SELECT m.*, least(1.0, n / 5.0) AS w, pr, pd FROM m JOIN a USING (site)),
  c AS (SELECT site, cal_month, n, greatest(least(w * coalesce(r, pr) + (1 - w) * pr, 2.0), 0.5) AS factor,
    CASE WHEN mid > 0 THEN greatest(least(w * d + (1 - w) * pd, mid), -0.5 * mid) ELSE w * d + (1 - w) * pd END AS "offset",
    CASE WHEN b0 IS NULL THEN NULL WHEN mid > 0 THEN greatest(least(b0, mid), -0.5 * mid) ELSE b0 END AS b0,
    CASE WHEN b1 IS NOT NULL THEN greatest(least(b1, 2.0), 0.5) END AS b1 FROM w),
  e AS (SELECT site, cal_month, avg(pow(x * factor - y, 2)) AS em, avg(pow(x + "offset" - y, 2)) AS ea, avg(pow(b0 + b1 * x - y, 2)) AS el
    FROM pr JOIN c USING (site) WHERE cal_month = month(month) GROUP BY 1, 2)
  SELECT site, cal_month, n, CASE WHEN n < 6 OR em = least(em, ea, el) THEN 'ratio' WHEN ea = least(em, ea, el) THEN 'offset' ELSE 'line' END AS form,
  round(factor, 6) AS factor, round("offset", 5) AS "offset", round(b0, 4) AS b0, round(b1, 6) AS b1 FROM c JOIN e USING (site, cal_month)""")  # fmt: skip
def bias_tier(spark, sf):
    d = B.bias_tier(_pairs(spark, sf).select("site", "month", "x", "y"), SITE)
    return d.select("site", "cal_month", "n", "form", F.round("factor", 6).alias("factor"), F.round("offset", 5).alias("offset"), F.round("b0", 4).alias("b0"), F.round("b1", 6).alias("b1"))


@query("quantile_mapping")
def quantile_mapping(spark, sf):
    return B.quantile_mapping(_pairs(spark, sf).select("site", "month", "x", "y"), SITE)


@query("plotting_return_period", f"""WITH {SITE_MONTHS}, f AS (SELECT site, avg(value) AS focus FROM sm WHERE year(month) BETWEEN 1997 AND 1998 GROUP BY 1),
  t AS (SELECT site, year(month) AS y, max(value) AS top FROM sm GROUP BY 1, 2),
  r AS (SELECT *, count(*) OVER (PARTITION BY site) AS n, row_number() OVER (PARTITION BY site ORDER BY top DESC, y) AS r FROM t)
  SELECT site, round(focus + 1e-9, 6) AS focus, top, round((n + 1) / r, 6) AS years FROM r JOIN f USING (site) QUALIFY row_number() OVER (PARTITION BY site ORDER BY abs(top - focus), r) = 1""")  # fmt: skip
def plotting_return_period(spark, sf):
    d = P.plotting_return_period(site_months(spark, sf), SITE, 1997, 1998)
    return r6(d.withColumn("focus", F.col("focus") + 1e-9), "focus", "years")


@query("continuised_margin", f"""WITH {SITE_MONTHS}, v AS (SELECT site, month, least(value, 800.0) AS v FROM sm),
  t AS (SELECT *, CASE WHEN count(*) FILTER (v >= top - 1e-6) OVER (PARTITION BY site) >= 2 AND v >= top - 1e-6 THEN 1 ELSE 0 END AS b
    FROM (SELECT *, max(v) OVER (PARTITION BY site) AS top FROM v)),
  p AS (SELECT *, sum(b) OVER s / count(*) OVER s AS p, count(*) OVER s - sum(b) OVER s AS n,
    rank() OVER (PARTITION BY site, b ORDER BY v) + (count(*) OVER (PARTITION BY site, b, v) - 1) / 2.0 AS rk,
    (CAST(('0x' || substr(md5(CAST(site AS VARCHAR) || '|' || CAST(month AS VARCHAR)), 1, 8)) AS UBIGINT) + 0.5) / 4294967296.0 AS h FROM t WINDOW s AS (PARTITION BY site))
  SELECT site, month, round(p, 6) AS p_top, round(least(greatest(CASE WHEN b = 1 THEN 1 - p + p * h ELSE (1 - p) * rk / (n + 1) END, 1e-6), 1 - 1e-6), 6) AS u FROM p""")  # fmt: skip
def continuised_margin(spark, sf):
    d = site_months(spark, sf).withColumn("v", F.least("value", F.lit(800.0)))
    return r6(P.continuised(d, SITE, "v", ["site", "month"]).select("site", "month", "p_top", "u"), "p_top", "u")


@query("rolling_tau", f"""WITH {SITE_MONTHS}, {_PAIR}, o AS (SELECT site, month, x, y, row_number() OVER (PARTITION BY site ORDER BY month) AS i FROM pr),
  g AS (SELECT c.site, c.month, count(*) FILTER (a.i = b.i) AS n, sum(sign(a.x - b.x) * sign(a.y - b.y)) FILTER (a.i < b.i) AS s,
    count(*) FILTER (a.i < b.i AND a.x <> b.x) AS na, count(*) FILTER (a.i < b.i AND a.y <> b.y) AS nb
    FROM o c JOIN o a ON a.site = c.site AND a.i BETWEEN c.i - 6 AND c.i + 6 JOIN o b ON b.site = c.site AND b.i BETWEEN c.i - 6 AND c.i + 6 GROUP BY 1, 2)
  SELECT site, month, n AS n_window, CASE WHEN n >= 6 THEN round(s / nullif(sqrt(CAST(na AS DOUBLE) * nb), 0), 6) END AS tau FROM g""")  # fmt: skip
def rolling_tau(spark, sf):
    return r6(P.rolling_tau(_pairs(spark, sf).select("site", "month", "x", "y"), SITE, "x", "y").drop("x", "y"), "tau")


@query("event_placement", f"""WITH {INDEX}, {_events_sql('idx', -0.5, -0.5)}, ar AS (SELECT month, round(avg(CASE WHEN z < -0.5 THEN 1.0 ELSE 0.0 END), 9) AS area FROM idv GROUP BY 1),
  ac AS (SELECT site, month, round(-z, 9) AS s, area AS a FROM idv JOIN ar USING (month) WHERE z < 0),
  g AS (SELECT site, avg(gap) AS mu FROM (SELECT site, datediff('month', lag(start) OVER (PARTITION BY site ORDER BY start), start) AS gap FROM ev) GROUP BY 1),
  i AS (SELECT ev.site, ev.start, s, a FROM ev JOIN ac ON ac.site = ev.site AND ac.month BETWEEN ev.start AND ev.finish),
  k AS (SELECT DISTINCT ON (site, start) site, start, 'peak' AS kind, s, a FROM i ORDER BY site, start, s DESC, a DESC),
  q AS (SELECT * FROM k UNION ALL SELECT site, start, 'mean', round(avg(s), 9), round(avg(a), 9) FROM i GROUP BY 1, 2),
  u AS (SELECT q.site, q.start, q.kind, q.s, q.a, count(*) FILTER (ac.s <= q.s) * 1.0 / (count(*) + 1) AS u, count(*) FILTER (ac.a <= q.a) * 1.0 / (count(*) + 1) AS v FROM q JOIN ac USING (site) GROUP BY 1, 2, 3, 4, 5),
  p AS (SELECT *, greatest(0.0, 1 - u - v + exp(-sqrt(ln(u) * ln(u) + ln(v) * ln(v)))) AS p FROM u)
  SELECT site, start, kind, round(s, 6) AS severity, round(p, 6) AS p_both, round(mu / (12 * nullif(p, 0)), 4) AS joint_years FROM p JOIN g USING (site) WHERE u > 0 AND v > 0""")  # fmt: skip
def event_placement(spark, sf):
    idx = index_values(spark, sf)
    area = idx.groupBy("month").agg(F.round(F.avg((F.col("z") < -0.5).cast("double")), 9).alias("area"))
    months = idx.join(area, "month").filter("z < 0").select("site", "month", F.round(-F.col("z"), 9).alias("severity"), "area")
    out = P.event_placement(months, E.detect_events(index_months(spark, sf), SITE, value="z"), SITE, "severity", "area").filter("u > 0 and v > 0")
    return out.select("site", "start", "kind", F.round("s", 6).alias("severity"), F.round("p_both", 6).alias("p_both"), F.round("joint_years", 4).alias("joint_years"))


@query("screened_stations", """WITH st AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '08K' ELSE '08J' END || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS station FROM nation),
  d AS (SELECT c_nationkey AS k, CASE o_orderstatus WHEN 'O' THEN 'Q' WHEN 'F' THEN 'H' ELSE o_orderstatus END AS kind, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey),
  a AS (SELECT station, min(y) FILTER (kind = 'Q') AS q1, max(y) FILTER (kind = 'Q') AS q2, min(y) FILTER (kind = 'H') AS h1, max(y) FILTER (kind = 'H') AS h2
    FROM st JOIN d ON k = n_nationkey WHERE kind IN ('Q', 'H') GROUP BY 1)
  SELECT station, least(q1, h1) AS rec_start, greatest(q2, h2) AS rec_end, greatest(q2, h2) - least(q1, h1) + 1 AS n_years,
  CASE WHEN station IN ('08J001', '08J004') THEN 'upstream' WHEN station IN ('08J002', '08J010') THEN 'downstream' ELSE 'unaffected' END AS place
  FROM a WHERE station LIKE '08J%' AND greatest(q2, h2) - least(q1, h1) + 1 >= 5 AND least(q1, h1) <= 1996 AND greatest(q2, h2) >= 1999""")  # fmt: skip
def screened_stations(spark, sf):
    name = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "08K").otherwise("08J"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    stations = table(spark, sf, "nation").select(name.alias("station"), F.col("n_nationkey").alias("c_nationkey"))
    data = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderdate").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    kind = F.when(F.col("o_orderstatus") == "O", "Q").when(F.col("o_orderstatus") == "F", "H").otherwise(F.col("o_orderstatus"))
    data = data.join(F.broadcast(stations), "c_nationkey").select("station", kind.alias("kind"), "o_orderdate")  # a nation table has 25 rows
    out = P.screened_stations(stations, data, "station", "kind", F.year("o_orderdate"), ("Q", "H"), "08J", ["08J001", "08J004"], ["08J002", "08J010"], 5, (1996, 1999))
    return out.select("station", "rec_start", "rec_end", "n_years", "place")


@query("regulation_labels", """WITH s AS (SELECT c_custkey AS lake, 50.0 + c_nationkey % 5 AS lat, 120.0 + floor(c_nationkey / 5) AS lon, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS e FROM customer)
  SELECT lake, CASE WHEN abs(lat - 52) <= 0.5 AND abs(lon - 122) <= 0.5 THEN 'impounded' WHEN lat BETWEEN 51 AND 53 AND lon BETWEEN 121 AND 122 AND (e IS NULL OR e >= 0) THEN 'likely impounded'
  WHEN lat BETWEEN 51 AND 54 AND lon BETWEEN 121 AND 124 AND NOT (lat BETWEEN 51 AND 53 AND lon BETWEEN 121 AND 122) THEN 'downstream' ELSE 'natural' END AS status FROM s""")  # fmt: skip
def regulation_labels(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    lat, lon = 50.0 + F.col("c_nationkey") % 5, 120.0 + F.floor(F.col("c_nationkey") / 5)
    status = P.regulation(lat, lon, F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")), (52.0, 122.0), 0.5, (51.0, 53.0, 121.0, 122.0), 0.0, (51.0, 54.0, 121.0, 124.0))
    return c.select(F.col("c_custkey").alias("lake"), status.alias("status"))


_TSD = f"""{SITE_MONTHS}, d AS (SELECT site, month, (value - avg(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) * 100 AS tsd FROM sp WINDOW w AS (PARTITION BY site, month(month)))"""
_RUNS = """v AS (SELECT *, sum(tsd) OVER w AS al, CASE WHEN tsd < 0 AND NOT coalesce(lag(tsd) OVER w < 0, false) THEN 1 ELSE 0 END AS nw FROM d WHERE tsd IS NOT NULL WINDOW w AS (PARTITION BY site ORDER BY month)),
  y AS (SELECT *, sum(nw) OVER (PARTITION BY site ORDER BY month) AS run FROM v),
  t AS (SELECT site, run, month, al, datediff('day', min(month) OVER (PARTITION BY site, run), month) / 30.44 AS t, sum(tsd) OVER (PARTITION BY site, run ORDER BY month) AS c FROM y WHERE tsd < 0),
  r AS (SELECT site, run, min(month) AS start, count(*) AS n, max_by(al, month) AS score, regr_slope(c, t) AS m, regr_intercept(c, t) AS b FROM t GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score, start) AS deep, row_number() OVER (PARTITION BY site ORDER BY n DESC, start) AS lg FROM r),
  h AS (SELECT *, max(CASE WHEN deep = 1 AND n < 6 THEN 1 ELSE 0 END) OVER (PARTITION BY site) AS short FROM o),
  pq AS (SELECT site, start, n AS n_run, 1 - m / (m + b) AS p, -3.0 / (m + b) AS q FROM h WHERE n >= 6 AND abs(m + b) >= 1e-6 AND 1 - m / (m + b) > 0 AND 1 - m / (m + b) < 1
    QUALIFY row_number() OVER (PARTITION BY site ORDER BY CASE WHEN short = 1 AND lg = 1 THEN 0 ELSE deep END, start) = 1)"""


@query("deficit_recurrence", f"WITH {_TSD}, {_RUNS} SELECT site, start, n_run, round(p, 6) AS p, round(q, 6) AS q FROM pq")
def deficit_recurrence(spark, sf):
    return r6(H.deficit_recurrence(H.storage_deficit(spined_months(spark, sf), SITE), SITE), "p", "q")


_BLOM = "((rk - 0.44) / (n + 0.12))"


@query("deficit_index_normal", f"""WITH RECURSIVE {_TSD}, {_RUNS}, e AS (SELECT d.site, month, tsd, p, q, row_number() OVER (PARTITION BY d.site ORDER BY month) AS i FROM d JOIN pq ON pq.site = d.site),
  f AS (SELECT site, month, i, 0.02 * tsd AS ix FROM e WHERE i = 1 UNION ALL SELECT e.site, e.month, e.i, CASE WHEN e.tsd IS NULL THEN f.ix WHEN f.ix IS NULL THEN 0.02 * e.tsd ELSE p * f.ix + q * e.tsd END FROM f JOIN e ON e.site = f.site AND e.i = f.i + 1),
  k AS (SELECT site, month, round(ix, 9) AS ix, rank() OVER (PARTITION BY site ORDER BY round(ix, 9)) + (count(*) OVER (PARTITION BY site, round(ix, 9)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY site) AS n FROM f WHERE ix IS NOT NULL)
  SELECT site, month, round(ix, 6) AS index, round({normal_quantile_sql(_BLOM)}, 6) AS z FROM k""")  # fmt: skip
def deficit_index_normal(spark, sf):
    sp = spined_months(spark, sf)
    fitted = H.deficit_recurrence(H.storage_deficit(sp, SITE), SITE)
    d = H.storage_deficit_index(sp, SITE, fitted=fitted).filter("index is not null").withColumn("index", F.round("index", 9))
    d = average_rank(d, SITE, "index")
    from pyspark.sql import Window

    p = (F.col("rank") - 0.44) / (F.count("*").over(Window.partitionBy("site")) + 0.12)
    return d.withColumn("p", p).select("site", "month", F.round("index", 6).alias("index"), F.round(normal_quantile("p"), 6).alias("z"))


@query("streamflow_index")
def streamflow_index(spark, sf):
    """With gates of 5 years and 50 months, as the tables hold 6 or 7 years."""
    return K.streamflow_index(spined_months(spark, sf), SITE, least_years=5, least_months=50)


@query("balance_variants")
def balance_variants(spark, sf):
    d = _pairs(spark, sf).select("site", "month", "x", (0.4 * F.col("y")).alias("y"), (0.5 * F.col("w")).alias("w"))
    return K.balance_variants(d, SITE, "x", {"penman": "y", "thornthwaite": "w"})


@query("area_frequency_curves")
def area_frequency_curves(spark, sf):
    idx = index_values(spark, sf)
    area = idx.groupBy("month").agg((100 * F.avg((F.col("z") < -0.5).cast("double"))).alias("area"))
    return K.area_frequency_curves(idx.join(area, "month").select("site", "month", "z", "area"), SITE)


@query("consensus_change")
def consensus_change(spark, sf):
    return K.consensus_change(_pairs(spark, sf).select("site", "month", "x", "y"), SITE, "x", "y")


@query("noise_envelope")
def noise_envelope(spark, sf):
    return K.noise_envelope(site_months(spark, sf), SITE)


@query("moderated_mediation")
def moderated_mediation(spark, sf):
    d = _pairs(spark, sf).withColumn("moderator", F.sin(F.month("month").cast("double")))
    return K.moderated_mediation(d, SITE, "x", "moderator", "y", "w")


@query("vine_order")
def vine_order(spark, sf):
    return K.vine_order(_pairs(spark, sf), SITE, ["x", "y", "w"])


@query("extreme_return_period")
def extreme_return_period(spark, sf):
    return K.extreme_return_period(site_months(spark, sf), SITE, 1997, 1998)


@query("kendall_return_period")
def kendall_return_period(spark, sf):
    return K.kendall_return_period(_pairs(spark, sf).withColumn("gap", F.lit(6.0)), SITE, "x", "y", "gap")


@query("lagged_composite", f"""WITH {INDEX}, e AS (SELECT month, avg(z) < -0.1 AS dry FROM idv GROUP BY 1),
  l AS (SELECT lag, CAST(month - to_months(CAST(lag AS INT)) AS DATE) AS month, dry FROM e, (SELECT unnest(range(0, 4)) AS lag)),
  j AS (SELECT sm.site, lag, value, dry FROM sm JOIN l USING (month))
  SELECT site, lag, count(*) FILTER (dry) AS n_event, round(avg(value) FILTER (dry) + 1e-9, 4) AS event_mean, round(avg(value) FILTER (NOT dry) + 1e-9, 4) AS other_mean FROM j GROUP BY 1, 2""")  # fmt: skip
def lagged_composite(spark, sf):
    e = index_values(spark, sf).groupBy("month").agg((F.avg("z") < -0.1).alias("dry"))
    out = A.lagged_composite(e, site_months(spark, sf), SITE, "dry", "value")
    return out.select("site", "lag", "n_event", F.round(F.col("event_mean") + 1e-9, 4).alias("event_mean"), F.round(F.col("other_mean") + 1e-9, 4).alias("other_mean"))


_JOINT = f"""{SITE_MONTHS}, {_PAIR}, {_U}, c AS (SELECT a.site, a.month, count(*) FILTER (b.u <= a.u AND b.v <= a.v) * 1.0 / count(*) AS base,
  count(*) FILTER (0.5 >= b.u AND b.v <= a.v) * 1.0 / count(*) AS nu, count(*) FILTER (b.u <= a.u AND 0.5 >= b.v) * 1.0 / count(*) AS nv FROM ps a JOIN ps b ON a.site = b.site GROUP BY 1, 2),
  g AS (SELECT *, abs(nu - base) + abs(nv - base) AS t FROM c)"""


@query("joint_index", f"""WITH {_JOINT} SELECT site, month, round(base, 6) AS copula, round((rank() OVER (PARTITION BY site ORDER BY round(base, 9)) + count(*) OVER (PARTITION BY site, round(base, 9)) - 1) * 1.0 / (count(*) OVER (PARTITION BY site) + 1), 6) AS place,
  round((nu - base) / CASE WHEN t = 0 THEN 1 ELSE t END, 6) AS share_u, round((nv - base) / CASE WHEN t = 0 THEN 1 ELSE t END, 6) AS share_v FROM g""")  # fmt: skip
def joint_index(spark, sf):
    d = Q.pseudo_observations(_pairs(spark, sf), SITE, ["x", "y"]).select("site", "month", F.col("u_x").alias("u"), F.col("u_y").alias("v"))
    return r6(K.joint_index(d, SITE, ["u", "v"]), "copula", "place", "share_u", "share_v")


@query("build_regions", """WITH p AS (SELECT c_custkey AS pixel, c_nationkey % 5 * 1.0 AS x, floor(c_nationkey / 5) * 1.0 AS y, c_acctbal AS elevation, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 37 % 360 * 1.0 END AS aspect FROM customer),
  q AS (SELECT quantile_cont(elevation, 0.25) AS a, quantile_cont(elevation, 0.5) AS b, quantile_cont(elevation, 0.75) AS c FROM p),
  r AS (SELECT p.*, CAST(((elevation > a)::INT + (elevation > b)::INT + (elevation > c)::INT) * 5 + CASE WHEN aspect IS NULL THEN 0 ELSE floor((aspect + 45) % 360 / 90) + 1 END AS INT) AS rg FROM p, q),
  m AS (SELECT rg, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM r GROUP BY 1),
  t AS (SELECT s.rg, l.rg AS target FROM m s, m l WHERE s.n < 60 AND l.n >= 60 QUALIFY row_number() OVER (PARTITION BY s.rg ORDER BY pow(s.mx - l.mx, 2) + pow(s.my - l.my, 2), l.rg) = 1)
  SELECT pixel, coalesce(target, r.rg) AS region FROM r LEFT JOIN t ON t.rg = r.rg""")  # fmt: skip
def build_regions(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    p = table(spark, sf, "customer").select(k.alias("pixel"), (n % 5 * 1.0).alias("x"), (F.floor(n / 5) * 1.0).alias("y"), F.col("c_acctbal").alias("elevation"), F.when(k % 7 != 0, k * 37 % 360 * 1.0).alias("aspect"))
    return S.build_regions(p, "pixel", least=60)


@query("region_homogeneity")
def region_homogeneity(spark, sf):
    return K.region_homogeneity(site_months(spark, sf).withColumn("region", F.col("site") % 3), ["region"], "site")


@query("regional_index")
def regional_index(spark, sf):
    """With a gate of 5 reference values, as the tables hold 6 or 7 years."""
    d = trailing(spined_months(spark, sf), SITE, 3).withColumn("region", F.col("site") % 3)
    return K.regional_index(d, ["region"], "site", 1995, 2000, least=5)
