"""Validated corrections, projections and special functions against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from xeric.functions.special import gamma_upper, log_gamma, solve
from xeric.operators import projection, validation


def test_log_gamma(spark):
    values = [1e-6, 0.1, 0.5, 1.0, 1.5, 2.0, 3.3, 10.0, 171.5, 1e5]
    got = spark.createDataFrame([(v,) for v in values], "a double").select(log_gamma(F.col("a"))).collect()
    assert np.allclose([r[0] for r in got], [math.lgamma(v) for v in values], rtol=1e-12, atol=1e-12)


def test_gamma_upper(spark):
    """Known values: exponential and Erlang tails, the error function, and the series by plain sums."""
    rows = [(1.0, x) for x in (0.0, 0.3, 1.9, 2.1, 40.0)] + [(0.5, x) for x in (0.01, 0.9, 1.4, 1.6, 20.0)] + [(5.0, x) for x in (0.5, 5.9, 6.1, 30.0)] + [(900.0, x) for x in (850.0, 899.0, 902.0, 1000.0)] + [(-1.0, 2.0), (None, 2.0), (2.0, -3.0)]

    def want(a, x):
        if a is None or a <= 0:
            return None
        if x <= 0:
            return 1.0
        if a == 0.5:
            return math.erfc(math.sqrt(x))
        return sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(int(a)))  # whole shapes

    got = [r[0] for r in spark.createDataFrame(rows, "a double, x double").select(gamma_upper(F.col("a"), F.col("x"))).collect()]
    for (a, x), g in zip(rows, got, strict=True):
        w = want(a, x)
        assert g is None if w is None else abs(g - w) < 1e-11


def test_solve(spark):
    r = np.random.default_rng(1)
    systems = []
    for _ in range(5):
        m = r.normal(size=(6, 6))
        systems.append(np.hstack([m @ m.T + np.eye(6), r.normal(size=(6, 1))]))
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(systems)] + [(9, [[1.0, 1.0, 1.0]] * 2)], "i int, m array<array<double>>")
    got = {x["i"]: x["v"] for x in df.filter("i < 9").select("i", solve(F.col("m"), 6).alias("v")).collect()}
    assert all(np.allclose(got[i], np.linalg.solve(s[:, :6], s[:, 6])) for i, s in enumerate(systems))
    assert df.filter("i = 9").select(solve(F.col("m"), 2)).first()[0] is None


def test_left_out_fits_equal_refitting(spark):
    r = np.random.default_rng(2)
    n, names = 240, [f"p{i}" for i in range(9)]
    x = r.normal(size=(n, 9)) * np.geomspace(0.01, 1000, 9) + np.linspace(-5, 500, 9)
    y = x @ (r.normal(size=9) / np.geomspace(0.01, 1000, 9)) + 40 + r.normal(size=n)
    station = r.choice(["a", "a", "a", "b", "c", "d"], n)
    rows = [(str(station[i]), float(y[i]), *map(float, x[i])) for i in range(n)] + [("a", None, *[1.0] * 9), ("e", 1.0, None, *[1.0] * 8)]
    df = spark.createDataFrame(rows, "station string, y double, " + ", ".join(f"{c} double" for c in names))
    got = validation.left_out_predictions(df, "station", "y", names, "p0").collect()
    assert len(got) == n
    for s in "abcd":
        a = np.hstack([np.ones((n, 1)), x])
        b = np.linalg.lstsq(a[station != s], y[station != s], rcond=None)[0]
        want = sorted(np.maximum(0, a[station == s] @ b))
        mine = sorted(g["predicted"] for g in got if g["station"] == s)
        assert np.allclose(mine, want, rtol=1e-6, atol=1e-6) and {g["n_fit"] for g in got if g["station"] == s} == {int((station != s).sum())}


def test_fits_that_cannot_be(spark):
    """Too few rows, or predictors that depend on each other: the raw value stands."""
    rows = [("a" if i % 2 else "b", float(i), float(i), 2.0 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "s string, y double, x double, x2 double")
    assert all(r["predicted"] == r["x"] for r in validation.left_out_predictions(df, "s", "y", ["x", "x2"], "x").collect())
    assert all(r["predicted"] == r["x"] for r in validation.left_out_predictions(df.limit(6), "s", "y", ["x"], "x").collect())
    assert validation.transfer_skill(df.limit(0), "s", "y", "x", {"line": ["x"]}).count() == 0


def test_screened_ratios(spark):
    rows = [(float(i), 2.0 * i + (i % 3)) for i in range(1, 40)] + [(1.0, 900.0), (0.0, 5.0), (None, 1.0), (2.0, -1.0)]
    got = validation.screen_ratios(spark.createDataFrame(rows, "m double, o double"), "o", "m").collect()
    ratio = np.array([o / m for m, o in rows[:40]])
    z = (ratio - ratio.mean()) / ratio.std(ddof=1)
    assert np.allclose([r["ratio_z"] for r in got[:40]], z) and [r["outlier"] for r in got] == [bool(abs(v) > 3) for v in z] + [False] * 3 and got[39]["outlier"]
    two = validation.screen_ratios(spark.createDataFrame(rows[:2], "m double, o double"), "o", "m").collect()
    assert [(r["ratio_z"], r["outlier"]) for r in two] == [(None, False)] * 2


def test_projection(spark):
    draws = spark.createDataFrame([(g, i, 0.2, 0.0, 1.0) for g in "ab" for i in range(3)] + [("b", 9, None, 0.0, 1.0)], "g string, d int, alpha double, beta double, phi double")
    years = spark.createDataFrame([(y, 0.0) for y in range(2000, 2010)], "year int, covariate double")
    annual = projection.annual_exceedance(draws, years, 3.0, 2.0)
    p = 1 - (1 - math.exp(-3 / math.exp(0.2))) ** 2  # a shape of 1 is exponential
    r = {(x["g"], x["year"]): x for x in projection.effective_return_period(annual, ["g"]).collect()}
    assert len(r) == 20 and r["b", 2003]["n"] == 3 and r["a", 2003]["p_50"] == pytest.approx(p) and r["a", 2003]["t_97_5"] == pytest.approx(1 / p)
    e = projection.expected_exceedances(annual, ["g"], "d", 2002, 2006).orderBy("g").collect()
    assert [x["n_years"] for x in e] == [5, 5] and e[0]["ene_50"] == pytest.approx(5 * p) and e[0]["return_50"] == pytest.approx(1 / p)
    with pytest.raises(ValueError):
        projection.annual_exceedance(draws, spark.range(3000).selectExpr("id AS year", "0.0 AS covariate"), 1.0, 1.0)
