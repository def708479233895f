"""Queries on moving and pooled fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from xeric.operators import frequency as Q
from xeric.operators import moving as M
from xeric.operators import risk as K

from .base import SITE_MONTHS, index_values, query, site_months, table
from .event_queries import _LM, SITE, _pairs, r6

_GROWTH = """p AS (SELECT site % 3 AS region, count(*) AS n_sites, sum(n * l2 / l1) / sum(n) AS t, sum(n * t3) / sum(n) AS t3 FROM lm GROUP BY 1),
  g AS (SELECT region, n_sites, years, t, -t3 AS k, t * sin(-t3 * pi()) / (-t3 * pi()) AS a FROM p, (SELECT unnest([2.0, 5.0, 10.0, 25.0, 50.0, 100.0])::DOUBLE AS years) WHERE n_sites >= 3 AND abs(t3) < 1),
  gc AS (SELECT region, n_sites, years, 1 - a * (1 / k - pi() / sin(k * pi())) + a / k * (1 - pow(1 / (years - 1), k)) AS growth FROM g)"""


def _pooled(spark, sf):
    sites = Q.l_moments(site_months(spark, sf), SITE).withColumn("region", F.col("site") % 3)
    return sites, Q.regional_l_moments(sites, ["region"])


@query("growth_curve", f"WITH {SITE_MONTHS}, {_LM}, {_GROWTH} SELECT region, n_sites, years, round(growth, 6) AS growth FROM gc")
def growth_curve(spark, sf):
    return r6(M.growth_curve(_pooled(spark, sf)[1], ["region"]), "growth")


@query("site_quantiles", f"WITH {SITE_MONTHS}, {_LM}, {_GROWTH} SELECT region, site, years, round(l1 * growth, 4) AS value FROM gc JOIN lm ON lm.site % 3 = region")
def site_quantiles(spark, sf):
    sites, pooled = _pooled(spark, sf)
    d = M.site_quantiles(M.growth_curve(pooled, ["region"]), sites, ["region"], "site")
    return d.select("region", "site", "years", F.round("value", 4).alias("value"))


@query("gated_growth_curve")
def gated_growth_curve(spark, sf):
    """Only of regions that are homogeneous enough."""
    h = K.region_homogeneity(site_months(spark, sf).withColumn("region", F.col("site") % 3), ["region"], "site")
    return M.growth_curve(_pooled(spark, sf)[1], ["region"], heterogeneity=h)


@query("threshold_search", """WITH cv AS (SELECT c_nationkey AS cell, month(o_orderdate) AS cal_month, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS cover
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  vl AS (SELECT c_nationkey AS cell, month(o_orderdate) AS cal_month, year(o_orderdate) AS y, sum(o_totalprice) > 400000 AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
  t AS (SELECT unnest([0.3, 0.45, 0.5, 0.55, 0.7])::DOUBLE AS threshold), ce AS (SELECT DISTINCT cell FROM cv),
  k AS (SELECT * FROM cv JOIN t ON cover >= threshold),
  yy AS (SELECT cell, threshold, y, max(p::INT) AS p FROM k JOIN vl USING (cell, cal_month) GROUP BY 1, 2, 3),
  bc AS (SELECT cell, threshold, sum(p) AS yrs, avg(p) AS st FROM yy GROUP BY 1, 2),
  g AS (SELECT threshold, median(1 - st) AS zero_share, median(coalesce(yrs, 0)) AS snow_years, 100 * avg(CASE WHEN coalesce(st, 0) >= 0.5 THEN 1.0 ELSE 0.0 END) AS stable_pct
    FROM (SELECT * FROM ce, t) LEFT JOIN bc USING (cell, threshold) GROUP BY 1),
  r AS (SELECT g.*, (SELECT count(*) FROM k WHERE k.threshold = g.threshold) / (12.0 * (SELECT count(*) FROM ce)) AS retained FROM g),
  s AS (SELECT *, round(0.3 * least(snow_years / 20, 1) + 0.25 * CASE WHEN zero_share IS NULL THEN 0 ELSE least(0.5 / (zero_share + 1e-9), 1) END + 0.2 * least(stable_pct / 50, 1)
    + 0.15 * CASE WHEN retained < 0.2 THEN 0 ELSE least(retained, 0.95) END + 0.05, 9) AS score FROM r)
  SELECT threshold, round(retained, 6) AS retained, round(zero_share, 6) AS zero_share, CAST(snow_years AS DOUBLE) AS snow_years, round(stable_pct, 6) AS stable_pct,
  round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, threshold) AS rank FROM s""")  # fmt: skip
def threshold_search(spark, sf):
    """Cover is made up of the share of finished orders, snow of what a month's orders have above 400,000."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cell")), "o_custkey")
    cover = o.groupBy("cell", F.month("o_orderdate").alias("cal_month")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("cover"))
    values = o.groupBy("cell", F.trunc("o_orderdate", "MM").alias("month")).agg((F.sum("o_totalprice") - 400000).alias("value"))
    d = M.threshold_search(cover, values, "cell", (0.3, 0.45, 0.5, 0.55, 0.7))
    return r6(d, "retained", "zero_share", "stable_pct", "score").withColumn("snow_years", F.col("snow_years").cast("double"))


@query("layer_months", """SELECT CAST(l_partkey % 3000 AS BIGINT) AS layer, CASE WHEN l_partkey % 3000 <= 1571 THEN CAST(DATE '1900-01-01' + to_months(CAST(l_partkey % 3000 AS INT)) AS DATE) END AS month,
  count(*) AS n FROM lineitem GROUP BY 1, 2""")  # fmt: skip
def layer_months(spark, sf):
    layer = (F.col("l_partkey") % 3000).cast("long")
    return table(spark, sf, "lineitem").groupBy(layer.alias("layer")).agg(F.count("*").alias("n")).withColumn("month", M.layer_month("1900-01-01", F.col("layer")))


@query("padded_layers", """SELECT id AS layer, n FROM range(60) t(id) LEFT JOIN (SELECT CAST(floor(o_totalprice / 10000) AS BIGINT) AS layer, count(*) AS n FROM orders GROUP BY 1) o ON o.layer = id""")
def padded_layers(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.floor(F.col("o_totalprice") / 10000).cast("long").alias("layer")).agg(F.count("*").alias("n"))
    return M.padded_layers(d, "layer", 60)


def _pseudo(spark, sf):
    return Q.pseudo_observations(_pairs(spark, sf), SITE, ["x", "y"])


@query("copula_choice")
def copula_choice(spark, sf):
    return M.copula_choice(_pseudo(spark, sf), SITE, "u_x", "u_y")


@query("copula_fit_test")
def copula_fit_test(spark, sf):
    return M.copula_fit_test(_pseudo(spark, sf), SITE, "u_x", "u_y")


@query("copula_stability")
def copula_stability(spark, sf):
    d = _pseudo(spark, sf).withColumn("raw", F.least("y", F.lit(800.0)))
    return M.copula_stability(d, SITE, "u_x", "raw")


@query("moving_copula")
def moving_copula(spark, sf):
    return M.moving_copula(_pseudo(spark, sf), SITE, "u_x", "u_y")


@query("moving_gamma")
def moving_gamma(spark, sf):
    return M.moving_gamma(site_months(spark, sf), SITE, "value")


@query("composite_bootstrap")
def composite_bootstrap(spark, sf):
    e = index_values(spark, sf).groupBy("month").agg((F.avg("z") < -0.1).alias("dry"))
    return M.composite_bootstrap(site_months(spark, sf).join(e, "month"), SITE, "dry", "value")


@query("bias_shift")
def bias_shift(spark, sf):
    d = _pairs(spark, sf).select("site", "month", (F.col("x") - F.col("y")).alias("bias"), F.col("w").alias("balance"))
    return M.bias_shift(d, SITE, "bias", "balance", F.year("month") < 1998, F.year("month") >= 1998)


@query("kmeans_regions")
def kmeans_regions(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("x"), F.floor(F.col("c_nationkey") / 5).alias("y"), F.col("c_acctbal").alias("elevation"))
    return M.kmeans_regions(c, "c_custkey", ["x", "y", "elevation"])


@query("fitted_supply")
def fitted_supply(spark, sf):
    return M.fitted_supply(_pairs(spark, sf), SITE, {"x": 0.6, "y": 0.4})


@query("effect_bounds")
def effect_bounds(spark, sf):
    d = _pairs(spark, sf).withColumn("moderator", F.sin(F.month("month").cast("double")))
    return M.effect_bounds(d, SITE, "x", "moderator", "w")
