"""Queries on what a correction did to trends and lows, and on bands by resampling and by error."""

from __future__ import annotations

from math import exp, factorial, log

from pyspark.sql import functions as F

from xeric.functions.labels import normal_quantile_sql
from xeric.operators import preservation as P

from .base import SITE_MONTHS, query, site_months
from .event_queries import _PAIR, SITE, _pairs, r6

#: erfc(sqrt(u)) by the series of the lower incomplete gamma function.
_TAIL = "CASE WHEN u <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 300), lambda n: exp(-u + (0.5 + n) * ln(u) - lgamma(n + 1.5)))) END"
_BOTH = """lo AS (SELECT site, year(month) AS t, 'raw' AS series, {how}(x) AS v FROM pr {where} GROUP BY 1, 2 UNION ALL SELECT site, year(month), 'corrected', {how}(y) FROM pr {where} GROUP BY 1, 2)"""


@query("trend_preservation", f"""WITH {SITE_MONTHS}, {_PAIR}, {_BOTH.format(how="max", where="")},
  s AS (SELECT a.site, a.series, sum(sign(b.v - a.v)) AS s, quantile_cont((b.v - a.v) / (b.t - a.t), 0.5) AS sen FROM lo a JOIN lo b ON a.site = b.site AND a.series = b.series AND a.t < b.t GROUP BY 1, 2),
  c AS (SELECT site, series, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS tied FROM (SELECT site, series, v, count(*) AS c FROM lo GROUP BY 1, 2, 3) GROUP BY 1, 2),
  z AS (SELECT site, series, n, sen, (n * (n - 1) * (2 * n + 5) - tied) / 18.0 AS vr, s FROM s JOIN c USING (site, series)),
  u AS (SELECT site, series, n, sen, CASE WHEN vr > 0 THEN (s - sign(s)) ** 2 / vr / 2 ELSE 0.0 END AS u FROM z), p AS (SELECT *, {_TAIL} AS p FROM u),
  w AS (SELECT a.site, a.n AS raw_n, a.sen AS a, a.p AS ap, b.n AS corrected_n, b.sen AS b, b.p AS bp, CASE WHEN a.sen <> 0 THEN abs((b.sen - a.sen) / a.sen) * 100 END AS change FROM p a JOIN p b ON a.site = b.site AND a.series = 'raw' AND b.series = 'corrected')
  SELECT site, CAST(raw_n AS BIGINT) AS raw_n, round(a, 6) AS raw_sen, round(ap, 6) AS raw_p, CAST(corrected_n AS BIGINT) AS corrected_n, round(b, 6) AS corrected_sen, round(bp, 6) AS corrected_p, round(change, 6) AS percent_change,
  sign(a) <> sign(b) AND ap < 0.1 AND bp < 0.1 AS sign_flip, (sign(a) <> sign(b) AND ap < 0.1 AND bp < 0.1) OR coalesce(change > 50, false) AS altered FROM w""")  # fmt: skip
def trend_preservation(spark, sf):
    d = P.trend_preservation(_pairs(spark, sf), SITE, "month", "x", "y")
    return r6(d, "raw_sen", "raw_p", "corrected_sen", "corrected_p", "percent_change")


_SHAPE = f"list_reduce(list_transform(range(1, {P.HALVINGS}), lambda i: 10.5 / pow(2, i)), lambda k, h: k + CASE WHEN 2 * (1 - pow(3, -k)) / (1 - pow(2, -k)) - 3 > t3 THEN h ELSE -h END, 9.50000001)"


def _level(period):
    return f"(l1 - sc * (1 - g) / k) + sc / k * (1 - pow({log(period)!r}, k))"


@query("return_level_change", f"""WITH {SITE_MONTHS}, {_PAIR}, {_BOTH.format(how="min", where="WHERE month(month) <= 3")},
  i AS (SELECT *, row_number() OVER w - 1.0 AS i, count(*) OVER (PARTITION BY site, series) AS n FROM lo WINDOW w AS (PARTITION BY site, series ORDER BY v)),
  b AS (SELECT site, series, count(*) AS n, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS spread, avg(v) AS l1, avg(v * i / (n - 1)) AS b1, avg(v * i / (n - 1) * (i - 1) / (n - 2)) AS b2 FROM i WHERE n >= 5 GROUP BY 1, 2),
  l AS (SELECT *, 2 * b1 - l1 AS l2, (6 * b2 - 6 * b1 + l1) / (2 * b1 - l1) AS t3 FROM b WHERE spread > 1e-6), k AS (SELECT *, {_SHAPE} AS k FROM l), g AS (SELECT *, gamma(1 + k) AS g, l2 * k / ((1 - pow(2, -k)) * gamma(1 + k)) AS sc FROM k),
  v AS (SELECT site, series, 20 AS period, {_level(20)} AS v FROM g UNION ALL SELECT site, series, 50, {_level(50)} FROM g),
  w AS (SELECT a.site, a.period, a.v AS a, b.v AS b, CASE WHEN abs(a.v) > 1e-6 THEN 100 * (b.v - a.v) / a.v END AS change FROM v a JOIN v b ON a.site = b.site AND a.period = b.period AND a.series = 'raw' AND b.series = 'corrected')
  SELECT site, period, round(a, 5) AS raw_level, round(b, 5) AS corrected_level, round(change, 3) AS percent_change, coalesce(abs(change) > 25, false) AS altered FROM w""")  # fmt: skip
def return_level_change(spark, sf):
    d = P.return_level_change(_pairs(spark, sf), SITE, "month", "x", "y", least=5)
    return d.withColumns({"raw_level": F.round("raw_level", 5), "corrected_level": F.round("corrected_level", 5), "percent_change": F.round("percent_change", 3)})


_CUTS = [sum(exp(-1) / factorial(j) for j in range(i + 1)) for i in range(P.MOST_COPIES)]
_BANDED = ", ".join(
    f"round(max(CASE WHEN r = 0 THEN {c} END) + 1e-8, 4) AS {c}, round(quantile_cont(CASE WHEN r > 0 THEN {c} END, 0.025) + 1e-8, 4) AS {c}_low, "
    f"round(quantile_cont(CASE WHEN r > 0 THEN {c} END, 0.975) + 1e-8, 4) AS {c}_high" for c in ("mean", "slope")
)


@query("resampled_band", f"""WITH {SITE_MONTHS}, b AS (SELECT site, year(month) AS year, count(*) AS n, sum(value) AS v FROM sm GROUP BY 1, 2),
  u AS (SELECT year, r, CASE WHEN r = 0 THEN -1.0 ELSE CAST('0x' || substr(md5('1:' || year || ':' || r), 1, 13) AS BIGINT) / 4503599627370496.0 END AS u FROM (SELECT DISTINCT year FROM b), range(0, 201) t(r)),
  c AS (SELECT year, r, CASE WHEN r = 0 THEN 1 ELSE {" + ".join(f"CAST(u >= {c!r} AS INTEGER)" for c in _CUTS)} END AS w FROM u),
  s AS (SELECT site, r, count(*) AS blocks, sum(w * n) AS n, sum(w * v) AS v, sum(w * n * (year - 1995)) AS t, sum(w * n * (year - 1995) ** 2) AS tt, sum(w * v * (year - 1995)) AS tv FROM b JOIN c USING (year) WHERE w > 0 GROUP BY 1, 2),
  m AS (SELECT site, r, blocks, v / n AS mean, CASE WHEN blocks > 1 THEN (tv - t * v / n) / (tt - t * t / n) END AS slope FROM s)
  SELECT site, max(CASE WHEN r = 0 THEN blocks END) AS n_blocks, {_BANDED} FROM m GROUP BY 1""")  # fmt: skip
def resampled_band(spark, sf):
    d = P.resampled_band(site_months(spark, sf).withColumn("year", F.year("month")), SITE, "year", "value")
    return d.withColumns({c: F.round(F.col(c) + 1e-8, 4) for c in d.columns[2:]})


_Z = normal_quantile_sql("p")
_GAMMA = "list_sum(list_transform(range(0, 400), lambda n: exp(-u + (sh + n) * ln(u) - lgamma(sh + n + 1))))"
_MIXED = "CASE WHEN method = 1 THEN dry + (1 - dry) * CASE WHEN v > 0 THEN g ELSE 0 END WHEN method = 2 THEN (rk - 0.44) / (al + 0.12) END"


@query("index_band", f"""WITH {SITE_MONTHS}, e AS (SELECT site, stddev_samp(value) / 4 AS e FROM sm GROUP BY 1),
  d AS (SELECT site, month, month(month) AS m, side, CASE WHEN side = 0 THEN value ELSE greatest(value + side * e, 0) END AS v FROM sm JOIN e USING (site), (VALUES (0), (1), (-1)) t(side) WHERE e IS NOT NULL),
  x AS (SELECT *, rank() OVER (PARTITION BY site, side, m ORDER BY v) + (count(*) OVER (PARTITION BY site, side, m, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY site, side, m) AS al FROM d),
  f AS (SELECT site, side, m, count(*) AS n, var_samp(v) AS vr, avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END) AS dry FROM d WHERE year(month) BETWEEN 1992 AND 1996 GROUP BY 1, 2, 3),
  i AS (SELECT *, row_number() OVER (PARTITION BY site, side, m ORDER BY v) - 1.0 AS i, count(*) OVER (PARTITION BY site, side, m) AS c FROM d WHERE year(month) BETWEEN 1992 AND 1996 AND v > 0),
  l AS (SELECT site, side, m, count(*) AS wet, avg(v) AS l1, CASE WHEN max(c) > 1 THEN (2 * avg(v * i / nullif(c - 1, 0)) - avg(v)) / avg(v) END AS t FROM i GROUP BY 1, 2, 3),
  h AS (SELECT *, CASE WHEN wet >= 4 AND t > 0 AND t < 1 THEN CASE WHEN t < 0.5 THEN (1 - 0.3080 * pi() * t * t) / (pi() * t * t - 0.05812 * pow(pi() * t * t, 2) + 0.01765 * pow(pi() * t * t, 3)) ELSE (0.7213 * (1 - t) - 0.5947 * pow(1 - t, 2)) / (1 - 2.1817 * (1 - t) + 1.2113 * pow(1 - t, 2)) END END AS sh FROM l),
  j AS (SELECT x.*, dry, sh, v * sh / l1 AS u, CASE WHEN n >= 4 AND vr < 2.2e-16 THEN 3 WHEN n >= 4 AND vr >= 0.01 AND sh IS NOT NULL THEN 1 WHEN al >= 3 THEN 2 END AS method FROM x LEFT JOIN f USING (site, side, m) LEFT JOIN h USING (site, side, m)),
  g AS (SELECT *, CASE WHEN method = 1 AND u > 0 THEN {_GAMMA} END AS g FROM j), p AS (SELECT site, month, side, method, greatest(1e-6, least(1 - 1e-6, {_MIXED})) AS p, {_MIXED} AS q FROM g),
  z AS (SELECT site, month, side, method, CASE WHEN method = 3 THEN 0.0 WHEN q IS NOT NULL THEN {_Z} END AS z FROM p)
  SELECT site, month, round(max(CASE WHEN side = 0 THEN z END), 5) AS z, CASE WHEN count(CASE WHEN side <> 0 THEN z END) = 2 THEN round(min(CASE WHEN side <> 0 THEN z END), 5) END AS z_lower,
  CASE WHEN count(CASE WHEN side <> 0 THEN z END) = 2 THEN round(max(CASE WHEN side <> 0 THEN z END), 5) END AS z_upper, max(CASE WHEN side = 0 THEN method END) AS method FROM z GROUP BY 1, 2""")  # fmt: skip
def index_band(spark, sf):
    sm = site_months(spark, sf)
    error = sm.groupBy("site").agg((F.stddev_samp("value") / 4).alias("error")).filter("error is not null")
    d = P.index_band(sm.join(error, "site"), SITE, "value", "month", F.col("error"), "1992-01-01", "1996-12-31", least=4)
    return d.withColumns({c: F.round(c, 5) for c in ("z", "z_lower", "z_upper")})
