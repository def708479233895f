"""Queries on series, labels, joins, aggregation and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from xeric.functions import labels as L
from xeric.operators import series as S
from xeric.operators import spatial as P
from xeric.operators.grids import nearest_feature as nearest_feature_of
from xeric.sources.tables import MONTHS, unpivot_months, wide_months, year_columns_to_long

from .base import DAILY, GAPPED, INDEX, SITE_MONTHS, WEIGHTS, daily, gapped, index_months, index_values, query, site_months, site_weights, spined_months, table

SITE = ["site"]


@query("scalar_labels", f"""WITH {SITE_MONTHS} SELECT site, month,
  CASE WHEN month(month) IN (12, 1, 2) THEN 'DJF' WHEN month(month) <= 5 THEN 'MAM' WHEN month(month) <= 8 THEN 'JJA' ELSE 'SON' END AS season,
  year(month) - CASE WHEN month(month) < 10 THEN 1 ELSE 0 END AS water_year, day(last_day(month)) AS days,
  round(value * day(last_day(month)), 3) AS month_total FROM sm""")  # fmt: skip
def scalar_labels(spark, sf):
    m = F.col("month")
    return site_months(spark, sf).select("site", "month", L.season(m).alias("season"), L.water_year(m).alias("water_year"), L.days_in_month(m).alias("days"), F.round(F.col("value") * L.days_in_month(m), 3).alias("month_total"))


@query("class_labels", f"""WITH {INDEX} SELECT site, month, z,
  CASE WHEN z <= -2 THEN 'D3' WHEN z <= -1.5 THEN 'D2' ELSE 'D1' END AS severity,
  CASE WHEN z >= 2 THEN 'W3' WHEN z >= 1.5 THEN 'W2' WHEN z >= 1 THEN 'W1' WHEN z <= -2 THEN 'D3' WHEN z <= -1.5 THEN 'D2' WHEN z <= -1 THEN 'D1' ELSE 'N' END AS seven,
  CASE WHEN z <= -4 THEN 'exceptional' WHEN z <= -3 THEN 'extreme' WHEN z <= -2 THEN 'severe' WHEN z <= -1 THEN 'moderate' WHEN z <= 0 THEN 'mild' WHEN z <= 2 THEN 'normal' ELSE 'wet' END AS supply,
  CASE WHEN z > 0 THEN 'none' WHEN z >= -1 THEN 'mild' WHEN z >= -1.5 THEN 'moderate' WHEN z >= -2 THEN 'severe' ELSE 'extreme' END AS groundwater,
  CASE WHEN z < -0.5 THEN 'Cool' WHEN z < 0.5 THEN 'Neutral' ELSE 'Warm' END AS phase,
  least(greatest(z, -1.2), 1.2) AS clipped FROM idv""")  # fmt: skip
def class_labels(spark, sf):
    z = F.col("z")
    return index_values(spark, sf).select("site", "month", "z", L.severity_class(z).alias("severity"), L.seven_classes(z).alias("seven"), L.supply_class(z).alias("supply"), L.groundwater_class(z).alias("groundwater"), L.oscillation_phase(z).alias("phase"), L.clip(z, -1.2, 1.2).alias("clipped"))


@query("standard_scores", f"""WITH {SITE_MONTHS} SELECT site, month,
  round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS score FROM sm WINDOW w AS (PARTITION BY site)""")
def standard_scores(spark, sf):
    w = Window.partitionBy("site")
    return site_months(spark, sf).select("site", "month", F.round((F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w), 6).alias("score"))


_WIDE = ", ".join(f"max(value) FILTER (month(month) = {i}) AS {m}" for i, m in enumerate(MONTHS, 1))


@query("year_month_pivot", f"WITH {SITE_MONTHS} SELECT site, year(month) AS year, {_WIDE} FROM sm GROUP BY ALL")
def year_month_pivot(spark, sf):
    return wide_months(site_months(spark, sf), SITE)


@query("wide_month_roundtrip", f"WITH {SITE_MONTHS} SELECT site, month, value FROM sm WHERE value IS NOT NULL")
def wide_month_roundtrip(spark, sf):
    return unpivot_months(wide_months(site_months(spark, sf), SITE), SITE).filter("value is not null")


@query("year_columns_to_long", f"WITH {SITE_MONTHS} SELECT site, year(month) AS year, value FROM sm WHERE month(month) = 7")
def year_columns(spark, sf):
    july = site_months(spark, sf).filter(F.month("month") == 7).withColumn("y", F.year("month").cast("string"))
    wide = july.groupBy("site").pivot("y", [str(y) for y in range(1990, 2010)]).agg(F.first("value"))
    return year_columns_to_long(wide, SITE).filter("value is not null")


@query("calendar_spine", f"""WITH {SITE_MONTHS}, f AS (SELECT * FROM sm WHERE month(month) <> 6),
  r AS (SELECT site, min(month) AS a, max(month) AS b FROM f GROUP BY site),
  s AS (SELECT site, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM r)
  SELECT s.site, s.month, f.value FROM s LEFT JOIN f ON s.site = f.site AND s.month = f.month""")  # fmt: skip
def calendar_spine(spark, sf):
    return S.calendar_spine(site_months(spark, sf).filter(F.month("month") != 6), SITE).select("site", "month", "value")


@query("complete_cases", f"WITH {GAPPED} SELECT site, count(*) AS n, count(z) AS n_complete, count(*) - count(z) AS n_dropped FROM gz GROUP BY site")
def complete_cases(spark, sf):
    g = gapped(index_months(spark, sf))
    return g.groupBy("site").agg(F.count("*").alias("n"), F.count("z").alias("n_complete"), (F.count("*") - F.count("z")).alias("n_dropped"))


@query("longitude_wrap", "SELECT s_suppkey, CASE WHEN s_suppkey * 7 % 360 > 180 THEN s_suppkey * 7 % 360 - 360 ELSE s_suppkey * 7 % 360 END AS lon FROM supplier")
def longitude_wrap(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", L.wrap_longitude(F.col("s_suppkey") * 7 % 360).alias("lon"))


@query("day_number_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def day_number_dates(spark, sf):
    code = F.year("o_orderdate") * 1000 + F.dayofyear("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", L.day_number_date(code).alias("date"))


@query("layer_dates", """WITH s AS (SELECT CAST(min(date_trunc('month', o_orderdate)) AS DATE) AS a, CAST(max(date_trunc('month', o_orderdate)) AS DATE) AS b FROM orders)
  SELECT unnest(range(0, 1 + date_diff('month', a, b))) AS layer, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM s""")  # fmt: skip
def layer_dates(spark, sf):
    span = table(spark, sf, "orders").agg(F.min(F.trunc("o_orderdate", "MM")).alias("a"), F.max(F.trunc("o_orderdate", "MM")).alias("b"))
    return span.select(F.posexplode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("layer", "month")).withColumn("layer", F.col("layer").cast("long"))


@query("priority_dedup", """WITH u AS (SELECT o_custkey AS well, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(substr(o_orderpriority, 1, 1) AS INT) AS source_rank, o_orderkey AS reading FROM orders)
  SELECT well, month, source_rank, reading FROM u QUALIFY row_number() OVER (PARTITION BY well, month ORDER BY source_rank, reading) = 1""")  # fmt: skip
def priority_dedup(spark, sf):
    u = table(spark, sf, "orders").select(F.col("o_custkey").alias("well"), F.trunc("o_orderdate", "MM").alias("month"), F.substring("o_orderpriority", 1, 1).cast("int").alias("source_rank"), F.col("o_orderkey").alias("reading"))
    return S.priority_dedup(u, ["well", "month"], "source_rank", ["reading"])


@query("network_merge", """WITH k AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS date, l_quantity AS v FROM lineitem)
  SELECT station, count(*) AS n_days, sum(CASE WHEN d > 1 THEN 1 ELSE 0 END) AS n_disagree, sum(first_value) AS first_total
  FROM (SELECT station, date, count(DISTINCT v) AS d, min(v) AS first_value FROM k GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
def network_merge(spark, sf):
    k = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("v"))
    one = k.groupBy("station", "date").agg(F.min("v").alias("first_value"), (F.max("v") > F.min("v")).alias("disagree"))
    return one.groupBy("station").agg(F.count("*").alias("n_days"), F.sum(F.col("disagree").cast("long")).alias("n_disagree"), F.sum("first_value").alias("first_total"))


@query("filtered_flow", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 0")
def filtered_flow(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus = 'O' and o_totalprice >= 0").select("o_orderkey", "o_totalprice")


@query("lag_shifted_join", f"WITH {INDEX} SELECT a.site, a.month, a.z, b.z AS earlier FROM idx a JOIN idx b ON a.site = b.site AND b.month = CAST(a.month - INTERVAL 4 MONTH AS DATE)")
def lag_shifted_join(spark, sf):
    idx = index_months(spark, sf).select("site", "month", "z")
    earlier = idx.select("site", F.add_months("month", 4).alias("month"), F.col("z").alias("earlier"))
    return idx.join(earlier, ["site", "month"])


@query("outer_join_chain", f"""WITH {SITE_MONTHS}, a AS (SELECT * FROM sm WHERE month(month) % 2 = 0), b AS (SELECT * FROM sm WHERE month(month) % 3 = 0), c AS (SELECT * FROM sm WHERE month(month) > 9)
  SELECT coalesce(a.site, b.site, c.site) AS site, coalesce(a.month, b.month, c.month) AS month, a.value AS v0, b.value AS v1, c.value AS v2
  FROM a FULL JOIN b ON a.site = b.site AND a.month = b.month FULL JOIN c ON c.site = coalesce(a.site, b.site) AND c.month = coalesce(a.month, b.month)""")  # fmt: skip
def outer_join_chain(spark, sf):
    sm, m = site_months(spark, sf), F.month("month")
    parts = [sm.filter(f).withColumnRenamed("value", f"v{i}") for i, f in enumerate((m % 2 == 0, m % 3 == 0, m > 9))]
    return reduce(lambda x, y: x.join(y, ["site", "month"], "full"), parts)


@query("right_join_years", f"""WITH {SITE_MONTHS}, y AS (SELECT year(month) AS year, round(avg(value), 6) AS covariate FROM sm GROUP BY 1)
  SELECT r AS year, covariate FROM (SELECT unnest(range(1990, 2006)) AS r) LEFT JOIN y ON y.year = r""")  # fmt: skip
def right_join_years(spark, sf):
    y = site_months(spark, sf).groupBy(F.year("month").cast("long").alias("year")).agg(F.round(F.avg("value"), 6).alias("covariate"))
    return y.join(spark.range(1990, 2006).withColumnRenamed("id", "year"), "year", "right")


@query("membership_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def membership_filter(spark, sf):
    inside = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(inside, "o_custkey", "left_semi").select("o_orderkey")


@query("alignment_check", f"""WITH {SITE_MONTHS}, a AS (SELECT DISTINCT month FROM sm WHERE site < 12), b AS (SELECT DISTINCT month FROM sm WHERE site >= 12 AND month(month) <> 5)
  SELECT month, 'only_a' AS side FROM (SELECT month FROM a EXCEPT SELECT month FROM b) UNION ALL SELECT month, 'only_b' FROM (SELECT month FROM b EXCEPT SELECT month FROM a)""")  # fmt: skip
def alignment_check(spark, sf):
    sm = site_months(spark, sf)
    a, b = sm.filter("site < 12").select("month").distinct(), sm.filter((F.col("site") >= 12) & (F.month("month") != 5)).select("month").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))


@query("nearest_feature", """WITH p AS (SELECT c_custkey, c_custkey * 13 % 1009 * 1.0 AS x, c_custkey * 29 % 997 * 1.0 AS y FROM customer),
  f AS (SELECT s_suppkey, s_suppkey * 37 % 1009 * 1.0 AS fx, s_suppkey * 53 % 997 * 1.0 AS fy FROM supplier)
  SELECT c_custkey, s_suppkey, round(d, 6) AS distance FROM (SELECT *, sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y)) AS d FROM p, f)
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) = 1""")  # fmt: skip
def nearest_feature(spark, sf):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    p = table(spark, sf, "customer").select("c_custkey", (c * 13 % 1009 * 1.0).alias("x"), (c * 29 % 997 * 1.0).alias("y"))
    f = table(spark, sf, "supplier").select("s_suppkey", (s * 37 % 1009 * 1.0).alias("fx"), (s * 53 % 997 * 1.0).alias("fy"))
    return nearest_feature_of(p, f, "c_custkey", "s_suppkey").withColumn("distance", F.round("distance", 6))


@query("point_to_cell", "SELECT c_custkey, CAST(floor((c_custkey * 13 % 1009 - 5.0) / 12.5) AS BIGINT) AS col, CAST(floor((c_custkey * 29 % 997 - 2.0) / 12.5) AS BIGINT) AS row FROM customer")
def point_to_cell(spark, sf):
    p = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 13 % 1009).alias("x"), (F.col("c_custkey") * 29 % 997).alias("y"))
    return P.grid_cell(p, 5.0, 2.0, 12.5).select("c_custkey", "col", "row")


@query("points_in_polygon", "SELECT c_custkey FROM (SELECT c_custkey, c_custkey * 13 % 1009 AS x, c_custkey * 29 % 997 AS y FROM customer) WHERE y >= 100 AND y < 800 AND x >= 50 AND x < 50 + (y - 100)")
def points_in_polygon(spark, sf):
    p = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 13 % 1009).alias("x"), (F.col("c_custkey") * 29 % 997).alias("y"))
    return P.in_polygon(p, [(50, 100), (750, 800), (50, 800)]).select("c_custkey")


@query("area_weighted_mean", f"""WITH {SITE_MONTHS}, {WEIGHTS}, g AS (SELECT site, CASE WHEN site % 7 = 3 THEN NULL ELSE weight END AS weight FROM sw),
  f AS (SELECT site, coalesce(weight, (SELECT median(weight) FROM g WHERE weight > 0)) AS weight FROM g)
  SELECT month, round(sum(value * weight) / sum(weight), 6) AS w_mean FROM sm JOIN f USING (site) GROUP BY month""")  # fmt: skip
def area_weighted_mean(spark, sf):
    w = P.repair_weights(site_weights(spark, sf).withColumn("weight", F.when(F.col("site") % 7 != 3, F.col("weight"))))
    return P.weighted_mean(site_months(spark, sf).join(w, "site"), ["month"]).select("month", F.round("w_mean", 6).alias("w_mean"))


@query("cosine_latitude_mean", f"WITH {SITE_MONTHS}, {WEIGHTS} SELECT month, round(sum(value * cos(radians(lat))) / sum(cos(radians(lat))), 6) AS w_mean FROM sm JOIN sw USING (site) GROUP BY month")
def cosine_latitude_mean(spark, sf):
    w = site_weights(spark, sf).withColumn("weight", F.cos(F.radians("lat")))
    return P.weighted_mean(site_months(spark, sf).join(w, "site"), ["month"]).select("month", F.round("w_mean", 6).alias("w_mean"))


@query("station_weighted_mean", f"""WITH {GAPPED}, {WEIGHTS} SELECT month, round(sum(z * weight) / sum(weight) FILTER (z IS NOT NULL), 6) AS w_mean,
  round(100 * sum(weight) FILTER (z IS NOT NULL) / sum(weight), 6) AS pct_covered FROM gz JOIN sw USING (site) GROUP BY month""")  # fmt: skip
def station_weighted_mean(spark, sf):
    d = gapped(index_months(spark, sf)).join(site_weights(spark, sf), "site")
    return P.weighted_mean(d, ["month"], "z").select("month", F.round("w_mean", 6).alias("w_mean"), F.round("pct_covered", 6).alias("pct_covered"))


@query("layer_statistics", f"""WITH {GAPPED}, {WEIGHTS} SELECT month, round(avg(z), 6) AS mean_value, round(sum(weight) FILTER (z IS NOT NULL) / sum(weight), 6) AS valid_fraction,
  round(coalesce(sum(weight) FILTER (z <= -0.5), 0) / sum(weight), 6) AS drought_fraction, round(100 * coalesce(sum(weight) FILTER (z < -0.5), 0) / sum(weight) FILTER (z IS NOT NULL), 6) AS extent_pct
  FROM gz JOIN sw USING (site) GROUP BY month""")  # fmt: skip
def layer_statistics(spark, sf):
    d = gapped(index_months(spark, sf)).join(site_weights(spark, sf), "site")
    out = P.layer_statistics(d, ["month"], -0.5, "z", "weight")
    return out.select("month", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("area_severity", f"""WITH {GAPPED} SELECT month, round(100.0 * count(*) FILTER (z < -0.5) / count(z), 6) AS area_pct,
  round(coalesce(avg(-0.5 - z) FILTER (z < -0.5), 0), 6) AS severity FROM gz GROUP BY month HAVING count(z) > 0""")  # fmt: skip
def area_severity(spark, sf):
    out = P.area_severity(gapped(index_months(spark, sf)), ["month"], -0.5, "z")
    return out.filter("area_pct is not null").select("month", F.round("area_pct", 6).alias("area_pct"), F.round("severity", 6).alias("severity"))


@query("annual_totals", f"""WITH {GAPPED} SELECT site, year(month) AS year, count(z) AS n_months, CASE WHEN count(z) >= 6 THEN round(sum(z), 6) END AS annual FROM gz GROUP BY 1, 2""")
def annual_totals(spark, sf):
    return S.annual(gapped(index_months(spark, sf)), SITE, "sum", 6, None, "z").withColumn("annual", F.round("annual", 6))


@query("warm_season_means", f"""WITH {GAPPED} SELECT site, year(month) AS year, count(z) AS n_months, CASE WHEN count(z) >= 4 THEN round(avg(z), 6) END AS annual FROM gz WHERE month(month) BETWEEN 4 AND 10 GROUP BY 1, 2""")
def warm_season_means(spark, sf):
    return S.annual(gapped(index_months(spark, sf)), SITE, "mean", 4, L.WARM_MONTHS, "z").withColumn("annual", F.round("annual", 6))


@query("complete_annual_totals", f"""WITH {SITE_MONTHS} SELECT site, year(month) AS year, count(value) AS n_months, CASE WHEN count(value) >= 12 THEN round(sum(value), 3) END AS annual FROM sm GROUP BY 1, 2""")
def complete_annual_totals(spark, sf):
    return S.annual(site_months(spark, sf), SITE, "sum", 12).withColumn("annual", F.round("annual", 3))


@query("daily_to_monthly_mean", f"""WITH {DAILY} SELECT station, CAST(date_trunc('month', date) AS DATE) AS month, count(value) AS n_days, CASE WHEN count(value) >= 15 THEN round(avg(value), 6) END AS monthly FROM dy GROUP BY 1, 2""")
def daily_to_monthly_mean(spark, sf):
    return S.daily_to_monthly(daily(spark, sf), ["station"], "mean", least_days=15).withColumn("monthly", F.round("monthly", 6))


@query("daily_to_monthly_total", f"""WITH {DAILY} SELECT station, CAST(date_trunc('month', date) AS DATE) AS month, count(value) AS n_days,
  CASE WHEN count(value) >= 0.8 * day(last_day(max(date))) THEN round(sum(value), 4) END AS monthly FROM dy GROUP BY 1, 2""")  # fmt: skip
def daily_to_monthly_total(spark, sf):
    return S.daily_to_monthly(daily(spark, sf), ["station"], "sum", least_share=0.8).withColumn("monthly", F.round("monthly", 4))


@query("monthly_volume", f"""WITH {SITE_MONTHS} SELECT site, month, round(value * day(last_day(month)) * 86400 / 1e6, 6) AS volume FROM sm""")
def monthly_volume(spark, sf):
    return site_months(spark, sf).select("site", "month", F.round(F.col("value") * L.days_in_month(F.col("month")) * 86400 / 1e6, 6).alias("volume"))


@query("submonthly_median", """SELECT s_nationkey AS lake, month, median(q) AS level, max(flag) AS flag FROM (
  SELECT s_nationkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CASE WHEN l_linenumber < 5 THEN l_quantity END AS q, l_linenumber AS flag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2""")  # fmt: skip
def submonthly_median(spark, sf):
    l, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("lake"))
    d = l.join(s, "l_suppkey").select("lake", F.trunc("l_shipdate", "MM").alias("month"), F.when(F.col("l_linenumber") < 5, F.col("l_quantity")).alias("q"), F.col("l_linenumber").alias("flag"))
    return d.groupBy("lake", "month").agg(F.median("q").alias("level"), F.max("flag").alias("flag"))


@query("pillow_two_level", """WITH m AS (SELECT s_nationkey AS region, l_suppkey AS pillow, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_quantity) AS a, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)
  SELECT region, month, round(avg(a), 6) AS swe, count(*) AS n_pillows FROM m WHERE n >= 5 GROUP BY 1, 2""")  # fmt: skip
def pillow_two_level(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("region"))
    m = table(spark, sf, "lineitem").join(s, "l_suppkey").groupBy("region", "l_suppkey", F.trunc("l_shipdate", "MM").alias("month")).agg(F.avg("l_quantity").alias("a"), F.count("*").alias("n"))
    return m.filter("n >= 5").groupBy("region", "month").agg(F.round(F.avg("a"), 6).alias("swe"), F.count("*").alias("n_pillows"))


@query("well_statistics", """SELECT o_custkey AS well, count(*) AS n, round(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) / 365.25, 6) AS record_years,
  string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS sources FROM orders GROUP BY 1""")  # fmt: skip
def well_statistics(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    return o.groupBy(F.col("o_custkey").alias("well")).agg(F.count("*").alias("n"), F.round(F.datediff(F.max("d"), F.min("d")) / 365.25, 6).alias("record_years"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("sources"))


@query("basin_summary", f"""WITH {INDEX} SELECT month, round(median(z), 6) AS middle, round(avg(z), 6) AS mean, round(stddev_samp(z), 6) AS sd, count(*) AS n,
  string_agg(DISTINCT CAST(site % 3 AS VARCHAR), ',' ORDER BY CAST(site % 3 AS VARCHAR)) AS sources FROM idx GROUP BY month""")  # fmt: skip
def basin_summary(spark, sf):
    return index_months(spark, sf).groupBy("month").agg(F.round(F.median("z"), 6).alias("middle"), F.round(F.avg("z"), 6).alias("mean"), F.round(F.stddev_samp("z"), 6).alias("sd"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set((F.col("site") % 3).cast("string"))), ",").alias("sources"))


@query("ratio_median_factor", f"""WITH {SITE_MONTHS}, p AS (SELECT a.site, a.month, a.value AS obs, b.value AS mod FROM sm a JOIN sm b ON a.month = b.month AND b.site = (a.site + 1) % 25),
  f AS (SELECT site, month(month) AS cal_month, count(*) AS n, median(obs / nullif(mod, 0)) AS m FROM p GROUP BY 1, 2)
  SELECT site, cal_month, n, CASE WHEN n < 6 THEN 1.0 ELSE round(m, 6) END AS factor FROM f""")  # fmt: skip
def ratio_median_factor(spark, sf):
    sm = site_months(spark, sf)
    mod = sm.select(((F.col("site") + 24) % 25).alias("site"), "month", F.col("value").alias("mod"))
    f = sm.withColumnRenamed("value", "obs").join(mod, ["site", "month"]).groupBy("site", F.month("month").alias("cal_month")).agg(F.count("*").alias("n"), F.median(F.try_divide("obs", "mod")).alias("m"))
    return f.select("site", "cal_month", "n", F.when(F.col("n") < 6, 1.0).otherwise(F.round("m", 6)).alias("factor"))


@query("climatology", f"WITH {SITE_MONTHS} SELECT site, month(month) AS cal_month, round(avg(value), 6) AS clim_mean, max(value) AS clim_max, min(value) AS clim_min FROM sm GROUP BY 1, 2")
def climatology(spark, sf):
    return S.climatology(site_months(spark, sf), SITE).withColumn("clim_mean", F.round("clim_mean", 6))


@query("anomaly_fixed_window", f"""WITH {SITE_MONTHS} SELECT site, month, round(value - avg(value) FILTER (year(month) BETWEEN 1996 AND 1999) OVER (PARTITION BY site, month(month)), 6) AS anomaly FROM sm""")
def anomaly_fixed_window(spark, sf):
    return S.anomaly(site_months(spark, sf), SITE, 1996, 1999).select("site", "month", F.round("anomaly", 6).alias("anomaly"))


@query("anomaly_full_period", f"""WITH {SITE_MONTHS} SELECT site, month, round(value - avg(value) OVER (PARTITION BY site, month(month)), 6) AS anomaly FROM sm""")
def anomaly_full_period(spark, sf):
    return S.anomaly(site_months(spark, sf), SITE).select("site", "month", F.round("anomaly", 6).alias("anomaly"))


@query("completeness", """WITH d AS (SELECT DISTINCT o_custkey AS station, CAST(o_orderdate AS DATE) AS date FROM orders), g AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY station ORDER BY date), date) - 1 AS gap FROM d)
  SELECT station, count(*) AS n_days, date_diff('day', CAST(date_trunc('month', min(date)) AS DATE), last_day(max(date))) + 1 AS span_days,
  round(100.0 * count(*) / (date_diff('day', CAST(date_trunc('month', min(date)) AS DATE), last_day(max(date))) + 1), 6) AS pct_complete,
  count(*) FILTER (gap > 14) AS n_gaps, coalesce(max(gap), 0) AS longest_gap FROM g GROUP BY station""")  # fmt: skip
def completeness(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("station"), F.to_date("o_orderdate").alias("date")).distinct().withColumn("value", F.lit(1))
    return S.completeness(d, ["station"]).withColumn("pct_complete", F.round("pct_complete", 6))


@query("first_covered_year", f"""WITH {SITE_MONTHS}, y AS (SELECT site, year(month) AS year, count(*) >= 11 AS ok FROM sm GROUP BY 1, 2),
  r AS (SELECT *, min(CAST(ok AS INT)) OVER w = 1 AND count(*) OVER w = 5 AS f FROM y WINDOW w AS (PARTITION BY site ORDER BY year ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
  SELECT site, min(year) FILTER (f) AS first_year, count(*) FILTER (ok) AS n_ok FROM r GROUP BY site""")  # fmt: skip
def first_covered_year(spark, sf):
    y = site_months(spark, sf).groupBy("site", F.year("month").alias("year")).agg((F.count("*") >= 11).alias("ok"))
    return S.first_covered_year(y, SITE)


@query("summary_statistics", f"""WITH {SITE_MONTHS} SELECT site, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean, round(median(value), 6) AS middle, round(stddev_samp(value), 6) AS sd, min(value) AS low, max(value) AS high,
  round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.9), 6) AS q90, count(DISTINCT year(month)) AS n_years FROM sm GROUP BY site""")  # fmt: skip
def summary_statistics(spark, sf):
    return site_months(spark, sf).groupBy("site").agg(F.count("*").alias("n"), F.round(F.avg("value") + 1e-9, 6).alias("mean"), F.round(F.median("value"), 6).alias("middle"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.percentile("value", F.lit(0.1)), 6).alias("q10"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("q90"), F.countDistinct(F.year("month")).alias("n_years"))


@query("conditional_probability", f"""WITH {INDEX}, t AS (SELECT z < -0.5 AS dry, CASE WHEN cal_month <= 4 THEN 'early' WHEN cal_month <= 8 THEN 'mid' ELSE 'late' END AS part, site % 2 = 0 AS even FROM idv)
  SELECT part, even, count(*) AS n, round(avg(CAST(dry AS INT)), 6) AS p_dry, round(avg(CAST(dry AS INT)) / (SELECT avg(CAST(dry AS INT)) FROM t), 6) AS ratio FROM t GROUP BY 1, 2""")  # fmt: skip
def conditional_probability(spark, sf):
    c = F.col("cal_month")
    t = index_values(spark, sf).select((F.col("z") < -0.5).cast("int").alias("dry"), L.chain([(c <= 4, "early"), (c <= 8, "mid")], "late").alias("part"), (F.col("site") % 2 == 0).alias("even"))
    g = t.groupBy("part", "even").agg(F.count("*").alias("n"), F.sum("dry").alias("d"))
    w = Window.partitionBy()
    p = F.col("d") / F.col("n")
    return g.select("part", "even", "n", F.round(p, 6).alias("p_dry"), F.round(p / (F.sum("d").over(w) / F.sum("n").over(w)), 6).alias("ratio"))


def _rolling(k: int, how: str) -> str:
    return f"""WITH {SITE_MONTHS} SELECT site, month, CASE WHEN count(value) OVER w = {k} THEN round({how}(value) OVER w + 1e-9, 4) END AS k_value
      FROM sp WINDOW w AS (PARTITION BY site ORDER BY month ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"""


@query("trailing_sum", _rolling(6, "sum"))
def trailing_sum(spark, sf):
    return S.trailing(spined_months(spark, sf), SITE, 6).select("site", "month", F.round(F.col("k_value") + 1e-9, 4).alias("k_value"))


@query("trailing_mean", _rolling(12, "avg"))
def trailing_mean(spark, sf):
    return S.trailing(spined_months(spark, sf), SITE, 12, "mean").select("site", "month", F.round(F.col("k_value") + 1e-9, 4).alias("k_value"))


@query("centred_mean", f"""WITH {SITE_MONTHS} SELECT site, month, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 3) END AS c_value
  FROM sp WINDOW w AS (PARTITION BY site ORDER BY month ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")  # fmt: skip
def centred_mean(spark, sf):
    return S.centred(spined_months(spark, sf), SITE, 2).select("site", "month", F.round("c_value", 3).alias("c_value"))


@query("average_rank", """SELECT p_partkey, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank FROM part""")
def average_rank(spark, sf):
    return S.average_rank(table(spark, sf, "part"), ["p_brand"], "p_size").select("p_partkey", "p_size", "rank")


@query("top_two_with_ties", """SELECT p_brand, p_partkey, p_size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) <= 2""")
def top_two_with_ties(spark, sf):
    return P.rank_top(table(spark, sf, "part"), ["p_brand"], [F.col("p_size").desc()], 2, ties=True).select("p_brand", "p_partkey", "p_size")


@query("head_by_group", """SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 3""")
def head_by_group(spark, sf):
    return P.rank_top(table(spark, sf, "part"), ["p_brand"], [F.col("p_size").desc(), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "p_size")


@query("water_year_to_date", f"""WITH {SITE_MONTHS} SELECT site, month, year(month) - CASE WHEN month(month) < 10 THEN 1 ELSE 0 END AS water_year,
  round(sum(value) OVER (PARTITION BY site, year(month) - CASE WHEN month(month) < 10 THEN 1 ELSE 0 END ORDER BY month), 3) AS to_date FROM sp""")  # fmt: skip
def water_year_to_date(spark, sf):
    return S.water_year_to_date(spined_months(spark, sf), SITE).select("site", "month", "water_year", F.round("to_date", 3).alias("to_date"))


@query("run_lengths", f"""WITH {INDEX}, f AS (SELECT site, month, z < 0 AS flag FROM idx),
  c AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(flag) OVER w IS NOT DISTINCT FROM flag THEN 0 ELSE 1 END AS ch FROM f WINDOW w AS (PARTITION BY site ORDER BY month)),
  r AS (SELECT *, sum(ch) OVER (PARTITION BY site ORDER BY month) AS run FROM c)
  SELECT site, run, flag, min(month) AS start, count(*) AS length FROM r GROUP BY 1, 2, 3""")  # fmt: skip
def run_lengths(spark, sf):
    return S.run_ids(index_months(spark, sf), SITE, F.col("z") < 0).groupBy("site", "run", "flag").agg(F.min("month").alias("start"), F.count("*").alias("length"))


@query("rolling_years_rank", f"""WITH {SITE_MONTHS}, y AS (SELECT site, year(month) AS year, avg(value) AS a, count(*) AS n FROM sm GROUP BY 1, 2),
  r AS (SELECT site, year, CASE WHEN sum(n) OVER w >= 0.9 * 36 THEN avg(a) OVER w END AS roll FROM y WINDOW w AS (PARTITION BY site ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
  SELECT site, year, round(roll, 6) AS roll, rank() OVER (PARTITION BY site ORDER BY roll) AS dry_rank, round((roll - avg(roll) OVER (PARTITION BY site)) / stddev_samp(roll) OVER (PARTITION BY site), 6) AS score FROM r WHERE roll IS NOT NULL""")  # fmt: skip
def rolling_years_rank(spark, sf):
    y = site_months(spark, sf).groupBy("site", F.year("month").alias("year")).agg(F.avg("value").alias("a"), F.count("*").alias("n"))
    w, g = Window.partitionBy("site").orderBy("year").rangeBetween(-2, 0), Window.partitionBy("site")
    r = y.withColumn("roll", F.when(F.sum("n").over(w) >= 0.9 * 36, F.avg("a").over(w))).filter("roll is not null")
    return r.select("site", "year", F.round("roll", 6).alias("roll"), F.rank().over(g.orderBy("roll")).alias("dry_rank"), F.round(F.try_divide(F.col("roll") - F.avg("roll").over(g), F.stddev_samp("roll").over(g)), 6).alias("score"))


@query("empirical_cdf", f"WITH {INDEX} SELECT site, month, round(cume_dist() OVER (PARTITION BY site ORDER BY z), 6) AS ecdf FROM idv")
def empirical_cdf(spark, sf):
    return index_values(spark, sf).select("site", "month", F.round(F.cume_dist().over(Window.partitionBy("site").orderBy("z")), 6).alias("ecdf"))


@query("double_mass", f"""WITH {SITE_MONTHS}, b AS (SELECT month, avg(value) AS base FROM sm GROUP BY 1)
  SELECT site, month, round(sum(value) OVER w, 3) AS own, round(sum(base) OVER w, 3) AS basin FROM sm JOIN b USING (month) WINDOW w AS (PARTITION BY site ORDER BY month)""")  # fmt: skip
def double_mass(spark, sf):
    sm = site_months(spark, sf)
    base = sm.groupBy("month").agg(F.avg("value").alias("base"))
    w = Window.partitionBy("site").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return sm.join(base, "month").select("site", "month", F.round(F.sum("value").over(w), 3).alias("own"), F.round(F.sum("base").over(w), 3).alias("basin"))


@query("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))).distinct()


@query("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("canonical_names", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS name, upper(p_brand) AS brand FROM part")
def canonical_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "").alias("name"), F.upper("p_brand").alias("brand"))
