"""Queries on validated corrections and projected draws."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from xeric.operators import additive as A
from xeric.operators import projection as J
from xeric.operators import validation as V

from .base import SITE_MONTHS, query, table
from .event_queries import _PAIR, SITE, _pairs, r6

_SEASON = f"round(sin({2 * pi} * month(month) / 12), 6)"


@query("screened_ratios", f"""WITH {SITE_MONTHS}, {_PAIR}, r AS (SELECT site, month, y / x AS r FROM pr WHERE x > 0 AND y > 0), s AS (SELECT avg(r) AS m, stddev_samp(r) AS sd FROM r)
  SELECT pr.site, pr.month, round((r - m) / sd, 6) AS ratio_z, coalesce(abs((r - m) / sd) > 2, false) AS outlier FROM s, pr LEFT JOIN r ON r.site = pr.site AND r.month = pr.month""")  # fmt: skip
def screened_ratios(spark, sf):
    return r6(V.screen_ratios(_pairs(spark, sf), "y", "x", 2.0).select("site", "month", "ratio_z", "outlier"), "ratio_z")


def _cells(spark, sf):
    """Pairs with a season and without outlying ratios."""
    d = V.screen_ratios(_pairs(spark, sf), "y", "x", 2.0).filter("not outlier")
    return d.withColumn("season", F.round(F.sin(2 * pi * F.month("month") / 12), 6)).select("site", "month", "x", "y", "season")


#: The fits anew, on all rows of the other sites, for each site.
_FITS = f"""{SITE_MONTHS}, {_PAIR}, r AS (SELECT avg(y / x) AS m, stddev_samp(y / x) AS sd FROM pr WHERE x > 0 AND y > 0),
  d AS (SELECT site, month, x, y, {_SEASON} AS s FROM pr, r WHERE NOT coalesce(x > 0 AND y > 0 AND abs((y / x - m) / sd) > 2, false)),
  t AS (SELECT DISTINCT site FROM d),
  f AS (SELECT t.site, count(*) AS n, avg(x) AS mx, avg(s) AS ms, avg(y) AS my, var_pop(x) AS vx, var_pop(s) AS vs, covar_pop(x, s) AS cxs, covar_pop(x, y) AS cxy, covar_pop(s, y) AS csy FROM t JOIN d ON d.site <> t.site GROUP BY 1),
  b AS (SELECT *, (cxy * vs - csy * cxs) / (vx * vs - cxs * cxs) AS b1, (csy * vx - cxy * cxs) / (vx * vs - cxs * cxs) AS b2 FROM f),
  e AS (SELECT d.*, b.n, greatest(0.0, my + b1 * (x - mx) + b2 * (s - ms)) AS two, greatest(0.0, my + cxy / vx * (x - mx)) AS one FROM d JOIN b USING (site))"""


@query("station_left_out", f"WITH {_FITS} SELECT site, month, n AS n_fit, round(two + 1e-9, 5) AS predicted FROM e")
def station_left_out(spark, sf):
    d = V.left_out_predictions(_cells(spark, sf), "site", "y", ["x", "season"], "x")
    return d.select("site", "month", "n_fit", F.round(F.col("predicted") + 1e-9, 5).alias("predicted"))


@query("transfer_skill", f"""WITH {_FITS}, m AS (SELECT 'none' AS model, site, x - y AS err FROM e UNION ALL SELECT 'line', site, one - y FROM e UNION ALL SELECT 'several', site, two - y FROM e),
  g AS (SELECT model, count(*) AS n, count(DISTINCT site) AS n_stations, sqrt(avg(err * err)) AS rmse, avg(err) AS bias FROM m GROUP BY 1)
  SELECT model, n, n_stations, round(rmse, 5) AS rmse, round(bias, 5) AS bias, CAST(row_number() OVER (ORDER BY rmse, model) AS INTEGER) AS rank FROM g""")  # fmt: skip
def transfer_skill(spark, sf):
    d = V.transfer_skill(_cells(spark, sf), "site", "y", "x", {"line": ["x"], "several": ["x", "season"]})
    return d.withColumns({c: F.round(c, 5) for c in ("rmse", "bias")})


def _annual(spark, sf):
    """Draws of each site's model made from its customers, over twelve years with a slow rise."""
    c = F.col("c_custkey")
    draws = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("site"), c.alias("draw"), (0.4 + c * 7 % 100 / 500).alias("alpha"), (0.1 + c * 13 % 90 / 600).alias("beta"), (0.6 + c * 11 % 70 / 20).alias("phi")
    )
    years = spark.range(12).select((F.col("id") + 2024).alias("year"), (F.col("id") * 0.25 - 1).alias("covariate"))
    return J.annual_exceedance(draws, years, 4.0, 1.3)


#: The lower incomplete gamma function by its series of 300 terms, each through the gamma function of the database.
_ANNUAL = """dr AS (SELECT c_nationkey AS site, c_custkey AS draw, 0.4 + c_custkey * 7 % 100 / 500 AS alpha, 0.1 + c_custkey * 13 % 90 / 600 AS beta, 0.6 + c_custkey * 11 % 70 / 20 AS phi FROM customer),
  yr AS (SELECT CAST(2024 + i AS INTEGER) AS year, i * 0.25 - 1 AS covariate FROM range(12) t(i)), q AS (SELECT *, 4.0 * phi / exp(alpha + beta * covariate) AS u FROM dr, yr),
  an AS (SELECT site, draw, year, 1 - pow(list_sum(list_transform(range(0, 300), lambda n: exp(-u + (phi + n) * ln(u) - lgamma(phi + n + 1)))), 1.3) AS p FROM q)"""


def _bands(column, stem):
    return ", ".join(f"round(quantile_cont({column}, {q}), 6) AS {stem}_{name}" for q, name in ((0.025, "2_5"), (0.25, "25"), (0.5, "50"), (0.75, "75"), (0.975, "97_5")))


@query("effective_return_period", f"WITH {_ANNUAL} SELECT site, year, count(*) AS n, {_bands('p', 'p')}, {_bands('1 / p', 't')} FROM an GROUP BY 1, 2")
def effective_return_period(spark, sf):
    d = J.effective_return_period(_annual(spark, sf), SITE)
    return r6(d, *d.columns[3:])


@query("expected_exceedances", f"""WITH {_ANNUAL}, e AS (SELECT site, draw, sum(p) AS e FROM an WHERE year BETWEEN 2026 AND 2033 GROUP BY 1, 2),
  g AS (SELECT site, 8 AS n_years, count(*) AS n, {_bands('e', 'ene').replace('round(', '(').replace(', 6) AS', ') AS')} FROM e GROUP BY 1)
  SELECT site, n_years, n, {", ".join(f"round(ene_{k}, 6) AS ene_{k}, round(8 / ene_{k}, 6) AS return_{k}" for k in ("2_5", "25", "50", "75", "97_5"))} FROM g""")  # fmt: skip
def expected_exceedances(spark, sf):
    d = J.expected_exceedances(_annual(spark, sf), SITE, "draw", 2026, 2033)
    return r6(d, *d.columns[3:])


def _additive(spark, sf):
    d = _pairs(spark, sf).withColumn("cal_month", F.month("month"))
    return d, A.fit_additive(d, "x", ["y", "w"], [("y", "w")], {"cal_month": (1.0, 13.0)})


@query("additive_shares")
def additive_shares(spark, sf):
    return A.variance_shares(*_additive(spark, sf))


@query("additive_terms")
def additive_terms(spark, sf):
    d, fit = _additive(spark, sf)
    return A.predict_terms(d.select("site", "month", "cal_month", "x", "y", "w"), fit)
