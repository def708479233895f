"""Regression regimes, drivers, paired detrending and Kendall curves against plain versions."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from xeric.operators import curves, events, series, trend


def month(i):
    return datetime.date(1980 + i // 12, i % 12 + 1, 1)


def test_ols_cusum_equals_numpy_and_finds_a_break(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for site in range(4):
        n = 120
        a, b = rng.normal(size=n), rng.normal(5, 2, size=n)
        y = 2 + 0.5 * a - 0.3 * b + rng.normal(0, 0.5, n) + (3.0 * (np.arange(n) >= 60) if site == 3 else 0)
        x = np.column_stack([np.ones(n), a, b])
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        run = np.abs(np.cumsum(e))
        stat = run.max() / math.sqrt(e @ e / (n - 3) * n)
        p = min(1.0, 2 * sum((-1) ** (k + 1) * math.exp(-2 * k * k * stat * stat) for k in range(1, 101)))
        want[site] = (n, stat, p, month(int(run.argmax())))
        rows += [(site, month(i), float(y[i]), float(a[i]), float(b[i])) for i in range(n)]
    rows += [(0, month(200), None, 1.0, 1.0), (8, month(0), 1.0, 1.0, 1.0), (None, month(0), 1.0, 1.0, 1.0)]
    rows += [(9, month(i), float(i), float(i % 3), float(i % 3) * 2) for i in range(20)]
    df = spark.createDataFrame(rows, "site int, month date, y double, a double, b double")
    got = {r["site"]: r for r in trend.ols_cusum(df, ["site"], "y", ["a", "b"]).collect()}
    assert set(got) == {0, 1, 2, 3, 9} and got[9]["statistic"] is None and got[9]["p"] is None and got[9]["change_at"] is None
    for s, (n, stat, p, at) in want.items():
        assert (got[s]["n"], got[s]["change_at"]) == (n, at)
        assert got[s]["statistic"] == pytest.approx(stat, rel=1e-9) and got[s]["p"] == pytest.approx(p, abs=1e-9)
    assert got[3]["p"] < 1e-6 and abs((got[3]["change_at"] - month(59)).days) < 62
    assert trend.ols_cusum(df.limit(0), ["site"], "y", ["a"]).collect() == []


def test_ols_cusum_shuffles_once(spark):
    df = spark.range(200).selectExpr("id % 3 AS site", "add_months(date'1990-01-01', int(id)) AS month", "rand(1) AS y", "rand(2) AS a")
    plan = trend.ols_cusum(df, ["site"], "y", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_primary_driver(spark):
    m = spark.createDataFrame([(1, month(i), x, y) for i, (x, y) in enumerate([(-1.0, -2.0), (-3.0, float("nan")), (0.0, -9.0), (-1.0, -1.0), (0.0, 0.0), (None, None)])], "site int, month date, a double, b double")
    e = spark.createDataFrame([(1, 1, month(0), month(1)), (1, 2, month(3), month(3)), (1, 3, month(5), month(5))], "site int, event int, start date, finish date")
    got = {r["event"]: (r["least_a"], r["least_b"], r["primary_driver"]) for r in events.primary_driver(m, e, ["site"], {"a": "Flow", "b": "Snow"}).collect()}
    assert got == {1: (-3.0, -2.0, "Flow"), 2: (-1.0, -1.0, "Flow"), 3: (None, None, "Unknown")}
    assert {r["primary_driver"] for r in events.primary_driver(m, e, ["site"], {"b": "Snow"}).collect()} == {"Snow", "Unknown"}


def test_detrended_dew_point_stays_under_its_temperature(spark):
    rows = [(1, datetime.date(1990 + i, 7, 1), 280.0 + 0.1 * i, 279.0 + 0.1 * i + (3.0 if i == 4 else 0.0)) for i in range(12)]
    rows += [(1, datetime.date(2003, 7, 1), 281.0, None), (1, datetime.date(1990, 8, 1), 5.0, 4.0)]
    got = {r["month"]: r for r in series.detrend_pair(spark.createDataFrame(rows, "site int, month date, t double, d double"), ["site"], "t", "d").collect()}
    july = [r for r in rows if r[1].month == 7]
    slope = {}
    for k in (2, 3):
        y, v = np.array([(r[1].year, r[k]) for r in july if r[k] is not None]).T
        slope[k] = (np.polyfit(y - y.mean(), v, 1)[0], y.mean())
    for _, when, t, d in july:
        free = [v - slope[k][0] * (when.year - slope[k][1]) if v is not None else None for k, v in ((2, t), (3, d))]
        assert got[when]["t_detrended"] == pytest.approx(free[0], abs=1e-9)
        assert got[when]["d_detrended"] == (None if d is None else pytest.approx(min(free), abs=1e-9))
    capped = got[datetime.date(1994, 7, 1)]
    assert capped["d_detrended"] == capped["t_detrended"]
    assert got[datetime.date(1990, 8, 1)]["t_detrended"] is None


def test_renewal_target(spark):
    def target(years, gap, cv):
        return spark.range(1).select(curves.renewal_target(F.lit(years), F.lit(gap), F.lit(cv).cast("double")).alias("t")).first()["t"]

    assert target(10.0, 8.0, 1.0) == target(10.0, 8.0, None) == target(10.0, 8.0, 0.0) == pytest.approx(1 - 8 / 120)
    k, rate = 1 / 4, 1 / 4 / 2  # cv 2, gap of two years
    x = rate * 10
    within = sum(math.exp((k + j) * math.log(x) - x - math.lgamma(k + j + 1)) for j in range(200))
    assert target(10.0, 24.0, 2.0) == pytest.approx(1 - within / 10 / 12, rel=1e-10)


def test_kendall_curves_equal_a_plain_version(spark):
    rng = np.random.default_rng(11)
    rows = []
    for site in (1, 2, 3):
        for i in range(240):
            z = float(rng.normal())
            a = float(np.clip(50 - (20 if site < 3 else -20) * z + rng.normal(0, 15), 0, 100))
            rows.append((site, month(i), z, a))
    rows += [(4, month(i), -1.0, 50.0) for i in range(40)] + [(5, month(0), -1.0, 5.0), (1, month(300), None, 3.0)]
    df = spark.createDataFrame(rows, "site int, month date, z double, area double")
    got = {(r["site"], r["years"], r["area_pct"]): r for r in curves.kendall_curves(df, ["site"]).collect()}
    assert {k[0] for k in got} == {1, 2} and len(got) == 2 * 4 * 19
    gap = {r["site"]: r["gap"] for r in events.detect_events(df, ["site"], -0.5, value="z").selectExpr("site", "months_between(start, lag(start) over (partition by site order by start)) g").groupBy("site").agg(F.avg("g").alias("gap")).collect()}
    for site in (1, 2):
        s, a = np.array([(-z, a) for k, _, z, a in rows if k == site and z is not None and z < 0 and a > 0]).T
        n = len(s)
        tau = sum(np.sign((s[i] - s[j]) * (a[i] - a[j])) for i in range(n) for j in range(i)) / (n * (n - 1) / 2)
        l1, l2 = s.mean(), 2 * (np.arange(n) * np.sort(s)).sum() / (n * (n - 1)) - s.mean()
        shape = -math.log(2) / math.log(1 - l2 / l1)
        scale, theta = l1 / math.gamma(1 + 1 / shape), 1 / (1 - tau)
        for years in (10.0, 100.0):
            target = 1 - gap[site] / (years * 12)
            for area in (5.0, 50.0, 95.0):
                r = got[(site, years, area)]
                assert r["tau"] == pytest.approx(tau)
                v = min(n / (n + 1), max(0.5 / (n + 1), (a <= area).sum() / (n + 1)))
                if r["severity"] is None:
                    assert v - v * math.log(v) / theta <= target + 1e-9
                    continue
                u = 1 - math.exp(-((r["severity"] / scale) ** shape))
                level = math.exp(-(((-math.log(u)) ** theta + (-math.log(v)) ** theta) ** (1 / theta)))
                assert level - level * math.log(level) / theta == pytest.approx(target, abs=1e-9)
    assert any(r["severity"] is not None for r in got.values())
    assert curves.kendall_curves(df.limit(0), ["site"]).collect() == []
