"""Trends and lows before and after a correction, resampled bands and reference indices against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from xeric.operators import preservation as P


def months(spark, rows, columns="site string, month date, x double, y double"):
    names = [c.split()[0] for c in columns.split(", ")]
    return spark.createDataFrame(rows, columns.replace("date", "string")).withColumn("month", F.col("month").cast("date")).select(*names)


def test_a_turned_trend_is_flagged(spark):
    r = np.random.default_rng(2)
    rows = [("kept", f"{1980 + t}-{m:02}-01", 100 + t + m / 10, 110 + 1.1 * t + m / 10) for t in range(20) for m in (1, 2)]
    rows += [("turned", f"{1980 + t}-01-01", 100.0 + t, 100.0 - t) for t in range(20)]
    rows += [("flat", f"{1980 + t}-01-01", 5.0, float(r.normal())) for t in range(20)]
    rows += [("one", "1980-01-01", 1.0, 2.0), ("none", "1980-01-01", None, None), ("nan", "1980-01-01", float("nan"), 1.0)]
    got = {x["site"]: x for x in P.trend_preservation(months(spark, rows), ["site"], "month", "x", "y").collect()}
    assert math.isclose(got["kept"]["raw_sen"], 1.0) and math.isclose(got["kept"]["corrected_sen"], 1.1, rel_tol=1e-9)
    assert not got["kept"]["sign_flip"] and not got["kept"]["altered"] and math.isclose(got["kept"]["percent_change"], 10, rel_tol=1e-6)
    assert got["turned"]["sign_flip"] and got["turned"]["altered"] and math.isclose(got["turned"]["percent_change"], 200)
    n, s = 20, 190  # every pair rises
    z = (s - 1) / math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    assert math.isclose(got["turned"]["raw_p"], math.erfc(z / math.sqrt(2)), rel_tol=1e-8)
    assert got["flat"]["raw_p"] == 1.0 and got["flat"]["percent_change"] is None and not got["flat"]["altered"]
    assert "none" not in got and all(got[s]["raw_sen"] is None and not got[s]["altered"] for s in ("one", "nan") if s in got)


@pytest.mark.parametrize("k", [-0.9, -0.3, -1e-4, 0.0, 1e-3, 0.2, 1.0, 4.0])
def test_shape_and_quantile_come_back(spark, k):
    """Shape and quantiles of a known distribution from its exact L-moments."""
    if k == 0:
        l2, t3, g = math.log(2), 2 * math.log(3) / math.log(2) - 3, 0.5772156649015329
        want = [-math.log(-math.log(p)) for p in (0.02, 0.5, 0.95)]
        l1 = g
    else:
        t3, l2 = 2 * (1 - 3**-k) / (1 - 2**-k) - 3, (1 - 2**-k) * math.gamma(1 + k) / k
        l1 = (1 - math.gamma(1 + k)) / k
        want = [(1 - (-math.log(p)) ** k) / k for p in (0.02, 0.5, 0.95)]
    d = spark.createDataFrame([(l1, l2, t3)], "l1 double, l2 double, t3 double").withColumn("k", P.extreme_value_shape(F.col("t3")))
    got = d.select("k", *[P.extreme_value_quantile(F.col("l1"), F.col("l2"), F.col("k"), p) for p in (0.02, 0.5, 0.95)]).first()
    assert abs(got[0] - k) < 1e-6 and np.allclose(got[1:], want, rtol=1e-5, atol=1e-5)


def test_shape_is_null_outside(spark):
    d = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "t3 double").select(P.extreme_value_shape(F.col("t3")))
    assert [x[0] for x in d.collect()] == [None] * 3


def test_levels_need_years_and_spread(spark):
    r = np.random.default_rng(5)
    rows = [("good", f"{1950 + t}-{m:02}-01", float(v), float(v) * 2) for t, v in enumerate(r.gamma(5, 10, 40)) for m in (1, 3)]
    rows += [("summer", f"{1950 + t}-07-01", 1.0 * t, 1.0) for t in range(40)] + [("short", f"{1950 + t}-01-01", 1.0 * t, 2.0 * t) for t in range(19)]
    rows += [("flat", f"{1950 + t}-01-01", 3.0, 1.0 * t) for t in range(40)]
    got = P.return_level_change(months(spark, rows), ["site"], "month", "x", "y").collect()
    assert sorted((x["site"], x["period"]) for x in got) == [("good", 20), ("good", 50)]
    assert all(abs(x["percent_change"] - 100) < 1e-6 and x["altered"] for x in got)


def test_resampled_band_reruns_agree_and_cover(spark):
    """The band of a mean and a slope hold the true ones about as often as they should; reruns and partitions agree."""
    r = np.random.default_rng(9)
    rows = [(f"s{s}", 1900 + t, float(50 + 0.2 * t + r.normal(0, 2))) for s in range(60) for t in range(60) for _ in range(2)]
    d = spark.createDataFrame([*rows, ("s0", 1900, None), ("s0", None, 1.0), ("s0", 1900, float("nan")), ("lone", 1900, 3.0)], "site string, year int, v double")
    first = {x["site"]: x for x in P.resampled_band(d, ["site"], "year", "v").collect()}
    again = {x["site"]: x for x in P.resampled_band(d.repartition(7, "v"), ["site"], "year", "v").collect()}
    for site, x in first.items():
        assert np.allclose([e or 0 for e in x[1:]], [e or 0 for e in again[site][1:]])
    assert first["lone"]["n_blocks"] == 1 and first["lone"]["slope"] is None and first["lone"]["mean"] == first["lone"]["mean_low"] == 3.0
    mine = [(y, v) for s, y, v in rows if s == "s7"]
    assert math.isclose(first["s7"]["slope"], np.polyfit(*np.array(mine).T, 1)[0], rel_tol=1e-9)
    covered = np.mean([x["slope_low"] <= 0.2 <= x["slope_high"] for s, x in first.items() if s != "lone"])
    assert covered >= 0.8


def test_copies_are_poisson(spark):
    w = np.array([x[0] for x in spark.range(400).select(P.block_copies(F.col("id"), 100, 3)).collect()])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs((w == 0).mean() - math.exp(-1)) < 0.01


def test_reference_index_branches(spark):
    r = np.random.default_rng(4)
    rows = []
    for t in range(30):
        d = f"{1980 + t}-01-01"
        rows += [("fit", d, float(r.gamma(3, 20)) if t % 5 else 0.0, None), ("constant", d, 7.0, None), ("narrow", d, 1 + t / 1000, None)]
    rows += [("new", f"{2005 + t}-01-01", 1.0 * t, None) for t in range(5)] + [("two", f"{2005 + t}-01-01", 1.0 * t, None) for t in range(2)] + [("fit", "2012-01-01", float("nan"), None), ("fit", "2013-01-01", None, None)]
    got = P.reference_index(months(spark, rows), ["site"], "x", "month", "1980-01-01", "2009-12-31").collect()
    method = {}
    for x in got:
        method.setdefault(x["site"], set()).add(x["method"])
    assert method == {"fit": {1, None}, "constant": {3}, "narrow": {2}, "new": {2}, "two": {None}}
    fit = sorted((x["x"], x["z"]) for x in got if x["site"] == "fit" and x["method"] == 1)
    assert all(a[1] <= b[1] for a, b in zip(fit, fit[1:], strict=False))
    assert abs(fit[0][1] - -0.8416) < 1e-3  # a fifth of the months is zero
    positive = [z for v, z in fit if v > 0]
    assert len(positive) == 24 and -0.8416 < min(positive) and max(positive) < 3.2


def test_index_band_holds_the_index(spark):
    r = np.random.default_rng(6)
    rows = [("a", f"{1980 + t}-{m:02}-01", float(r.gamma(4, 10)), None) for t in range(25) for m in range(1, 13)]
    d = months(spark, rows)
    got = P.index_band(d, ["site"], "x", "month", 4.0, "1980-01-01", "2009-12-31").collect()
    assert len(got) == 300 and all(x["z_lower"] <= x["z_upper"] for x in got)
    none = P.index_band(d, ["site"], "x", "month", 0.0, "1980-01-01", "2009-12-31").collect()
    assert all(x["z"] == x["z_lower"] == x["z_upper"] for x in none)
    assert P.index_band(d.limit(0), ["site"], "x", "month", 1.0, "1980-01-01", "2009-12-31").count() == 0


def test_no_python_and_no_single_task(spark):
    d = spark.range(100).select((F.col("id") % 3).alias("site"), F.col("id").alias("year"), F.rand(1).alias("v"))
    plan = P.resampled_band(d, ["site"], "year", "v")._jdf.queryExecution().toString()
    assert "Python" not in plan and "SinglePartition" not in plan
