import datetime

import numpy as np
import pytest

from xeric.functions import fit_kernels as M
from xeric.functions import kernels as K
from xeric.operators import moving


def months(n, start=1980):
    return [datetime.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


PARAMETERS = {"frank": 4.0, "gumbel": 2.0, "plackett": 6.0, "survival_clayton": 2.0, "joe": 2.5, "gaussian": 0.6, "student": 0.6, "clayton": 1.5}


@pytest.mark.parametrize("family", PARAMETERS)
def test_density_is_the_slope_of_the_conditional(family):
    p, v, h = PARAMETERS[family], np.array([0.2, 0.5, 0.7]), 1e-5
    for a in (0.15, 0.5, 0.8):
        u = np.full(3, a)
        slope = (M.conditional(family, p, u + h, v) - M.conditional(family, p, u - h, v)) / (2 * h)
        assert np.abs(np.exp(M.log_density(family, p, u, v)) - slope).max() < 2e-3, family
    ends = M.conditional(family, p, np.array([1e-9, 1 - 1e-9]), np.array([0.4, 0.4]))
    assert ends[0] < 1e-3 and ends[1] > 1 - 1e-3


@pytest.mark.parametrize("family", M.FAMILIES)
def test_samples_give_their_parameter_back(family):
    u, v = M.sample(family, PARAMETERS[family], 1500, np.random.Generator(np.random.PCG64(5)))
    got = M.parameter(family, u, v, K.kendall_tau(u, v))
    assert abs(got - PARAMETERS[family]) < (0.08 if family in ("gaussian", "student") else 1.2 if family == "plackett" else 0.35)


def test_choice_prefers_upper_tails_within_the_slack():
    u, v = M.sample("gumbel", 2.5, 400, np.random.Generator(np.random.PCG64(1)))
    assert M.choose_copula(u, v)[0] in ("gumbel", "survival_clayton", "joe")
    assert M.choose_copula(u, v, 0.7, True, 1e9)[0] in ("gumbel", "joe") and M.choose_copula(u, v, 0.7, False) == M.choose_copula(u, v)
    x = np.linspace(0.02, 0.98, 40)
    assert M.choose_copula(x, 1 - x)[0] in ("frank", "plackett", "gaussian", "student")


def test_fit_test_accepts_its_own_family_and_knows_a_wrong_one():
    u, v = M.sample("gumbel", 2.0, 120, np.random.Generator(np.random.PCG64(2)))
    u, v = (K.average_ranks(x) / (len(x) + 1) for x in (u, v))
    assert M.goodness_of_fit(u, v, 60)[3] > 0.05
    t = np.linspace(0, 4 * np.pi, 120)
    a, b = (K.average_ranks(x) / 121 for x in (np.cos(t) + 0.01 * t, np.sin(t) + 0.013 * t))
    assert M.goodness_of_fit(a, b, 60)[3] < 0.05
    assert M.goodness_of_fit(u, v, 20) == M.goodness_of_fit(u, v, 20)


def test_stability_without_ties_is_whole():
    u, v = M.sample("joe", 3.0, 100, np.random.Generator(np.random.PCG64(3)))
    family, share, cv, stable = M.family_stability(u, v)
    assert share == 1.0 and cv < 1e-12 and stable and family in M.FAMILIES


def test_moving_dependence_is_found_and_constant_kept():
    r = np.random.Generator(np.random.PCG64(4))
    years = np.repeat(np.arange(1980.0, 2020.0), 10)
    u, v = M.sample("clayton", 2.0, 400, r)
    still = M.moving_copula(u, v, years)
    assert still[1] == "constant" and still[3] > 0.01
    a, b = M.sample("clayton", 0.2, 200, r)
    c, d = M.sample("clayton", 5.0, 200, r)
    moved = M.moving_copula(np.append(a, c), np.append(b, d), years)
    assert moved[1] == "split" and moved[3] < 1e-6 and moved[2] > 0


def test_moving_gamma_finds_its_trend():
    r = np.random.Generator(np.random.PCG64(6))
    years = np.repeat(np.arange(1980.0, 2020.0), 10)
    flat = M.moving_gamma(r.gamma(4.0, 2.0, 400), years)
    assert flat[1] > 0.01 and flat[2] == pytest.approx(8.0, rel=0.2) and flat[4] == pytest.approx(0.5, abs=0.1)
    t = (years - 1999.5) / years.std()
    model, p, early, late, *_ = M.moving_gamma(r.gamma(4.0, 2.0 * np.exp(0.4 * t)), years)
    assert model in ("mean", "mean_spread") and p < 1e-6 and late > 1.5 * early


def test_minimise_finds_a_valley():
    x, v = M.minimise(lambda a: (a[0] - 3) ** 2 + 10 * (a[1] - a[0] ** 2) ** 2, np.zeros(2), 2000)
    assert np.abs(x - [3, 9]).max() < 1e-3 and v < 1e-6


def test_margins_know_weibull_and_beta():
    q = (np.arange(1000) + 0.5) / 1000
    family, (k, scale), _ = K.best_margin(5 * (-np.log(1 - q)) ** (1 / 3.5))
    assert family == "weibull" and k == pytest.approx(3.5, rel=0.03) and scale == pytest.approx(5, rel=0.02)
    r = np.random.Generator(np.random.PCG64(7))
    family, (a, b), _ = K.best_margin(r.beta(0.7, 0.5, 3000))
    assert family == "beta" and a == pytest.approx(0.7, rel=0.1) and b == pytest.approx(0.5, rel=0.1)


def test_bootstrap_of_composites(spark):
    r = np.random.Generator(np.random.PCG64(8))
    m = months(240)
    rows = [(s, t, i % 7 < 2, float(r.normal() + (2.0 if s == 1 and i % 7 < 2 else 0.0))) for s in (1, 2) for i, t in enumerate(m)]
    rows += [(3, t, False, 1.0) for t in m[:10]]
    d = spark.createDataFrame(rows, "site int, month date, dry boolean, value double")
    got = {x["site"]: x for x in moving.composite_bootstrap(d, ["site"], "dry", "value", draws=1000).collect()}
    assert set(got) == {1, 2} and got[1]["p_adjusted"] < 0.01 and 1.5 < got[1]["low"] < got[1]["difference"] < got[1]["high"] < 2.5
    assert got[2]["p"] > 0.01 and got[2]["low"] < got[2]["difference"] < got[2]["high"]


def test_bias_shift_by_calendar_month(spark):
    from pyspark.sql import functions as F

    rows = [(1, t, 1.0 + (2.0 if t.year >= 1990 else 0.0) + 0.1 * (t.year % 2), float(t.year % 5)) for t in months(240)]
    d = spark.createDataFrame(rows, "site int, month date, bias double, balance double")
    got = moving.bias_shift(d, ["site"], "bias", "balance", F.year("month") < 1990, F.year("month") >= 1990).collect()
    assert len(got) == 12
    for x in got:
        assert x["n_early"] == x["n_late"] == 10 and abs(x["delta"] - 2.0) < 1e-9 and x["low"] < 2.0 < x["high"]
        assert x["delta_index"] == pytest.approx(2.0 / np.std([t % 5 for t in range(1980, 1990)], ddof=1))


def test_growth_curve_is_a_logistic_of_mean_one_and_is_gated(spark):
    d = spark.createDataFrame([("a", 4, 0.2, 0.15), ("b", 4, 0.2, 0.0), ("c", 2, 0.2, 0.1), ("d", 5, 0.2, -0.2)], "region string, n_sites int, t double, t3 double")
    got = {(r["region"], r["years"]): r["growth"] for r in moving.growth_curve(d, ["region"], (1.001, 2.0, 100.0)).collect()}
    assert {r for r, _ in got} == {"a", "b", "d"} and got["b", 2.0] == pytest.approx(1.0)
    for region, t3 in (("a", 0.15), ("d", -0.2)):
        par = K.fit_glo(1.0, 0.2, t3)
        for y in (1.001, 2.0, 100.0):
            assert K.cdf_glo(np.array([got[region, y]]), par)[0] == pytest.approx(1 - 1 / y, abs=1e-9)
    h = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "region string, h double")
    assert {r["region"] for r in moving.growth_curve(d, ["region"], heterogeneity=h).collect()} == {"a"}


def test_kmeans_regions_find_separate_groups(spark):
    r = np.random.Generator(np.random.PCG64(9))
    rows = [(i, float(10 * (i % 3) + r.normal(0, 0.3)), float(5 * (i % 3) + r.normal(0, 0.3))) for i in range(150)] + [(999, None, 1.0)]
    d = spark.createDataFrame(rows, "pixel int, x double, y double")
    got = {x["pixel"]: x["region"] for x in moving.kmeans_regions(d, "pixel", ["x", "y"], 3).collect()}
    assert len(got) == 150 and all(got[i] == i % 3 for i in range(150))


def test_threshold_search_scores(spark):
    cover = spark.createDataFrame([(c, m, 0.5 if c == 1 else 0.1) for c in (1, 2) for m in range(1, 13)], "cell int, cal_month int, cover double")
    values = spark.createDataFrame([(c, t, 1.0 if c == 1 and t.year % 2 else None) for c in (1, 2) for t in months(240)], "cell int, month date, value double")
    got = {r["threshold"]: r for r in moving.threshold_search(cover, values, "cell", (0.05, 0.3, 0.9)).collect()}
    assert (got[0.05]["retained"], got[0.05]["zero_share"], got[0.05]["snow_years"], got[0.05]["stable_pct"]) == (1.0, 0.75, 5.0, 50.0)
    assert (got[0.3]["retained"], got[0.3]["zero_share"], got[0.3]["snow_years"], got[0.3]["stable_pct"]) == (0.5, 0.5, 5.0, 50.0)
    assert got[0.9]["retained"] == 0 and got[0.9]["zero_share"] is None and got[0.9]["score"] == pytest.approx(0.05)
    assert got[0.3]["score"] == pytest.approx(0.3 * 0.25 + 0.25 + 0.2 + 0.15 * 0.5 + 0.05, abs=1e-6) and got[0.3]["rank"] == 1


def test_supply_with_fits(spark):
    r = np.random.Generator(np.random.PCG64(10))
    rows = [(1, t, float(r.gamma(2.0, 3.0)), None if i == 3 else float(r.normal()), 7.0) for i, t in enumerate(months(360))]
    d = spark.createDataFrame(rows, "site int, month date, x double, y double, z double")
    got = {x["month"]: x["supply"] for x in moving.fitted_supply(d, ["site"], {"x": 0.5, "y": 0.5}).collect()}
    assert len(got) == 360 and got[months(360)[3]] is None and abs(np.mean([v for v in got.values() if v is not None])) < 0.1
    z, method = M.gamma_or_places(np.array([x[2] for x in rows]))
    assert method == "gamma" and abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.1
    assert M.gamma_or_places(np.array([-1.0, 2.0, 3.0]))[1] == "places" and M.gamma_or_places(np.full(5, 7.0))[1] == "constant"
    assert M.gamma_or_places(np.array([np.nan]))[1] is None


def test_effect_bounds():
    r = np.random.Generator(np.random.PCG64(11))
    x, w = r.normal(size=500), r.normal(size=500)
    effect, change, low, high = M.johnson_neyman(x, w, x * (0.2 + w) + 0.5 * r.normal(size=500))
    assert effect == pytest.approx(0.2, abs=0.1) and change == pytest.approx(1.0, abs=0.1) and low < -0.2 < high and high - low < 0.4
    assert np.isnan(M.johnson_neyman(np.ones(20), w[:20], x[:20])[0])


def test_layers(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(0, 1.0), (2, 3.0), (1572, 1.0)], "layer int, v double").withColumn("month", moving.layer_month("1900-01-01", F.col("layer")))
    got = {r["layer"]: r["month"] for r in d.collect()}
    assert got[2] == datetime.date(1900, 3, 1) and got[1572] is None
    assert [(r["layer"], r["v"]) for r in moving.padded_layers(d.drop("month"), "layer", 4).orderBy("layer").collect()] == [(0, 1.0), (1, None), (2, 3.0), (3, None)]
