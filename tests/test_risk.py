import datetime

import numpy as np
import pandas as pd
import pytest

from xeric.functions import kernels as K
from xeric.functions import risk_kernels as R
from xeric.operators import bias, physical, placement, risk
from xeric.operators.series import calendar_spine, trailing


def months(n, start=1980):
    return [datetime.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def test_a_missing_month_leaves_its_sums_null(spark):
    m = months(12)
    d = spark.createDataFrame([(1, t, float(i)) for i, t in enumerate(m) if i != 5], "site int, month date, value double")
    got = {r["month"]: r["k_value"] for r in trailing(calendar_spine(d, ["site"]), ["site"], 3).collect()}
    assert len(got) == 12 and [got[t] for t in m[5:8]] == [None] * 3 and got[m[4]] == 9.0 and got[m[8]] == 21.0


@pytest.mark.parametrize("name", sorted(R.FLOW))
def test_flow_families_give_back_their_own_quantiles(name):
    r = np.random.default_rng(3)
    v = np.sort(r.gamma(3.0, 20.0, 4000))
    fit, cdf = R.FLOW[name]
    l1, l2, t3, _ = K.l_moments(v)
    p = cdf(v, fit(l1, l2, t3))
    assert (np.diff(p) >= -1e-12).all() and p.min() >= 0 and p.max() <= 1
    assert np.abs(p - (np.arange(4000) + 0.5) / 4000).max() < (0.02 if name in ("pe3", "ln3", "gev", "weibull") else 0.08)


def test_flow_family_of_known_samples():
    q = (np.arange(2000) + 0.5) / 2000
    assert R.flow_family(5 - np.log(-np.log(q)) * 2)[0] == "gev"
    assert R.flow_family(3 + np.exp(0.6 * K.norm_quantile(q)))[0] == "ln3"
    assert R.flow_family(10 + (1 - (1 - q) ** 0.3) / 0.3)[0] in ("gpa", "weibull")  # a Pareto fit may end below the largest value
    z, name = R.streamflow_index(np.append(3 + np.exp(0.6 * K.norm_quantile(q)), [0.0, np.nan]))
    assert name == "ln3" and abs(np.nanmean(z[:2000])) < 0.01 and z[2000] == z.min() or z[2000] < -3
    assert np.isnan(z[2001]) and R.streamflow_index(np.arange(5.0))[1] is None


def test_conditional_levels_are_derivatives():
    def joint(family, p, u, v):
        if family == "clayton":
            return (u**-p + v**-p - 1) ** (-1 / p)
        if family == "gumbel":
            return np.exp(-(((-np.log(u)) ** p + (-np.log(v)) ** p) ** (1 / p)))
        if family == "frank":
            return -np.log1p(np.expm1(-p * u) * np.expm1(-p * v) / np.expm1(-p)) / p
        a, b = (1 - u) ** p, (1 - v) ** p
        return 1 - (a + b - a * b) ** (1 / p)

    u = np.array([0.1, 0.4, 0.8])
    for family, p in (("clayton", 1.5), ("gumbel", 2.0), ("frank", 3.0), ("joe", 2.5)):
        for v in (0.2, 0.7):
            slope = (joint(family, p, u, v + 1e-6) - joint(family, p, u, v - 1e-6)) / 2e-6
            assert np.abs(R.conditional_level(family, p, u, v) - slope).max() < 1e-5, family
        got = R.conditional_severity(family, p, 0.9, 0.3)
        assert abs(R.conditional_level(family, p, np.array([got]), 0.3)[0] - 0.9) < 1e-6
    assert abs(R.conditional_severity("gaussian", 0.5, 0.9, 0.5) - K.norm_cdf(1.2815515655 * np.sqrt(0.75))) < 1e-6


def test_renewal_target():
    assert R.renewal_target(10, 6, 1.0) == pytest.approx(1 - 0.05)
    assert R.renewal_target(10, 6, float("nan")) == pytest.approx(0.95)
    p = float(K.gamma_p(4.0, np.array([4.0 / 8 * 10]))[0])
    assert R.renewal_target(10, 96, 0.5 - 1e-12) == pytest.approx(1 - p / 120, abs=1e-6)


def test_curves_rise_with_the_return_period():
    r = np.random.default_rng(2)
    a = r.uniform(5, 95, 200)
    s = a / 50 + r.gamma(2, 0.3, 200)
    rows = R.saf_curves(s, a, 12.0, 1.0)
    by = {(t, x): v for t, x, v, _ in rows}
    assert len(rows) == 4 * 19 and all(by[10.0, x] < by[100.0, x] for x in (5.0, 50.0, 95.0))
    assert by[50.0, 95.0] > by[50.0, 5.0] and R.saf_curves(s[:5], a[:5], 12.0, 1.0) == []


def test_changes_found_by_two_of_three():
    r = np.random.default_rng(6)
    tau = np.concatenate([r.normal(0.1, 0.05, 40), r.normal(0.7, 0.05, 40)])
    years = 1980 + np.arange(80) // 2
    u = r.uniform(0.01, 0.99, 80)
    v = np.concatenate([r.uniform(0.01, 0.99, 40), np.clip(u[40:] + r.normal(0, 0.02, 40), 0.01, 0.99)])
    out = R.consensus_change(tau, years, u, v)
    assert out[6] and abs(out[7] - 2000) <= 3 and out[1] < 0.01 and out[3] < 0.01
    quiet = R.consensus_change(r.normal(0, 1, 80), years, r.uniform(0.01, 0.99, 80), r.uniform(0.01, 0.99, 80))
    assert not quiet[6] and R.consensus_change(np.full(80, np.nan), years, u, v)[6] is False


def test_spectral_line_and_white_noise():
    assert K.degrees_of_freedom((3, 5), 0.0) == pytest.approx(10.4, abs=0.1) and K.degrees_of_freedom() == pytest.approx(9.3, abs=0.1)
    r = np.random.default_rng(1)
    x = np.sin(2 * np.pi * np.arange(480) / 60) * 2 + r.normal(0, 1, 480)
    peaks = K.spectral_peaks(x)
    assert len(peaks) == 1 and abs(peaks[0][0] - 60) < 8
    out = R.white_noise_envelope(x)
    assert any(o and abs(t - 60) < 10 for t, _, o in out)
    assert np.mean([o for _, _, o in R.white_noise_envelope(r.normal(0, 1, 480))]) < 0.15


def test_moderated_mediation_of_a_known_system():
    r = np.random.default_rng(4)
    x, w = r.normal(0, 1, (2, 4000))
    m = 0.5 * x + 0.2 * x * w + r.normal(0, 0.1, 4000)
    y = 0.8 * m + 0.3 * x + 0.1 * m * w + r.normal(0, 0.1, 4000)
    out = R.moderated_mediation(x, w, m, y, draws=40)
    assert out["indirect_mid"] == pytest.approx(0.4, abs=0.02) and out["direct"] == pytest.approx(0.3, abs=0.02)
    assert out["indirect_high"] == pytest.approx(0.7 * 0.9, abs=0.04) and out["mid_low"] < 0.4 < out["mid_high"]
    assert out["moderation"] == pytest.approx(0.2 * 0.8 + 0.5 * 0.1 + 0.2 * 0.1, abs=0.03) and R.moderated_mediation(x[:5], w[:5], m[:5], y[:5]) == {}


def test_vine_order_by_hand():
    t = np.array([[1, 0.2, 0.6, 0.1], [0.2, 1, 0.3, 0.5], [0.6, 0.3, 1, -0.4], [0.1, 0.5, -0.4, 1]])
    assert R.vine_order(t) == [0, 2, 3, 1]


def test_extreme_return_periods():
    q = (np.arange(400) + 0.5) / 400
    top = -np.log(-np.log(q))
    assert R.gev_return_period(top, -np.log(-np.log(0.98))) == pytest.approx(50, rel=0.05)
    assert np.isnan(R.gev_return_period(top[:3], 1.0))


def test_polynomials_left_out_as_if_fitted_anew():
    r = np.random.default_rng(5)
    x = np.sort(r.uniform(0, 10, 20))
    y = np.sort(2 + 0.3 * x**1.5 + r.normal(0, 0.2, 20))
    c, error = bias.monotone_polynomial(x, y)
    degree = len(c) - 1
    left = []
    for i in range(20):
        keep = np.arange(20) != i
        left.append(y[i] - np.polyval(np.polyfit(x[keep], y[keep], degree), x[i]))
    assert error == pytest.approx(np.sqrt(np.mean(np.square(left))), rel=1e-6)
    falling = bias.monotone_polynomial(x, y[::-1].copy())
    assert falling is None and bias.monotone_polynomial(np.ones(5), y[:5]) is None
    # The last point alone fixes the line at its place.
    assert bias.monotone_polynomial(np.array([1.0] * 6 + [100.0]), np.arange(7.0)) is None


def test_bias_tier_of_few_pairs_leans_on_all_months(spark):
    rows = [(1, datetime.date(1990 + k, 1, 1), 10.0 + k, 2.0 * (10 + k)) for k in range(8)] + [(1, datetime.date(1990, 2, 1), 10.0, 10.0), (1, datetime.date(1991, 2, 1), None, 3.0)]
    out = {r["cal_month"]: r for r in bias.bias_tier(spark.createDataFrame(rows, "site int, month date, x double, y double"), ["site"]).collect()}
    assert out[1]["n"] == 8 and out[1]["form"] == "ratio" and out[1]["factor"] == 2.0
    assert out[2]["n"] == 1 and out[2]["form"] == "ratio" and out[2]["factor"] == pytest.approx(0.2 * 1 + 0.8 * 2) and out[2]["b0"] is None


def test_curves_of_many_lakes(spark):
    curve = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 10.0), ("a", 4.0, 40.0), ("b", 2.0, 5.0), ("b", 3.0, 6.0)], "lake string, level double, storage double")
    r = spark.createDataFrame([("a", 0.5), ("a", 4.0), ("a", 4.1), ("a", -1.0), ("b", 2.5), ("b", 3.0), ("b", 3.5), ("a", None)], "lake string, stage double")
    got = sorted(map(tuple, physical.stage_storage(r, curve, lake=("lake",)).select("lake", "stage", "storage").collect()), key=str)
    want = [("a", 0.5, 5.0), ("a", 4.0, 40.0), ("a", 4.1, None), ("a", -1.0, None), ("b", 2.5, 5.5), ("b", 3.0, 6.0), ("b", 3.5, None), ("a", None, None)]
    assert got == sorted(want, key=str)


def test_rolling_tau_counts_ties(spark):
    x, y = [1, 2, 2, 4, 5, 3, 7], [1, 3, 2, 4, 4, 6, 7]
    d = spark.createDataFrame([(1, t, a, b) for t, a, b in zip(months(7), x, y, strict=True)], "site int, month date, x int, y int")
    got = placement.rolling_tau(d, ["site"], "x", "y", half=6).orderBy("month").collect()
    s = pd.DataFrame({"x": x, "y": y})
    i, j = np.triu_indices(7, 1)
    sx, sy = (np.sign(s[c].to_numpy()[j] - s[c].to_numpy()[i]) for c in "xy")
    assert got[0]["tau"] == pytest.approx((sx * sy).sum() / np.sqrt((sx != 0).sum() * (sy != 0).sum())) and got[0]["n_window"] == 7
    assert placement.rolling_tau(d.limit(4), ["site"], "x", "y").first()["tau"] is None


def test_operators_of_records_with_gaps(spark):
    r = np.random.default_rng(8)
    rows = [(s, t, float(v) if v > 0.3 else None) for s in (1, 2) for t, v in zip(months(150), r.gamma(2, 1, 150), strict=True)]
    d = spark.createDataFrame(rows, "site int, month date, value double")
    flow = risk.streamflow_index(d, ["site"], least_months=100).collect()
    assert len(flow) == 300 and all((x["z"] is None) == (v is None) for x, v in zip(sorted(flow, key=lambda q: (q["site"], q["month"])), [q[2] for q in rows], strict=True))
    assert risk.streamflow_index(d, ["site"], least_months=151).count() == 0
    assert {x["site"] for x in risk.noise_envelope(d, ["site"]).collect()} == {1, 2}


def test_patterns_weighted_by_latitude(spark):
    from xeric.operators.patterns import eof

    r = np.random.default_rng(3)
    base = r.normal(0, 1, 60)
    x = np.stack([base + r.normal(0, 0.3, 60) for _ in range(4)], 1)
    lat = [0.0, 30.0, 60.0, 80.0]
    rows = [(s, t, float(x[i, s]), lat[s]) for i, t in enumerate(months(60)) for s in range(4) if not (i == 7 and s == 2)]
    patterns, scores = eof(spark.createDataFrame(rows, "site int, month date, value double, lat double"), "site", "month", "value", 2, lat="lat", kaiser=True)
    keep = np.arange(60) != 7
    own = [np.array([v for s, _, v, _ in rows if s == k]) for k in range(4)]
    z = np.stack([(x[keep, k] - own[k].mean()) / own[k].std(ddof=1) * np.sqrt(np.cos(np.radians(lat[k]))) for k in range(4)], 1)
    vec = np.linalg.eigh(z.T @ z)[1][:, -1]
    got = [r["pattern_1"] for r in patterns.orderBy("site").collect()]
    assert np.allclose(np.abs(got), np.abs(vec)) and len(patterns.columns) == 2 and scores.count() == 59


def test_kendall_return_periods_grow_with_depth():
    r = np.random.default_rng(11)
    x = r.gamma(2, 1, 80)
    y = x + r.gamma(2, 0.3, 80)
    family, years = R.kendall_return_periods(x, y, 6.0)
    assert family in ("clayton", "gumbel", "frank", "joe") and years[np.argmax(x + y)] > np.median(years) and (years >= 0.5 - 1e-9).all()


def test_remote_tables(spark, tmp_path):
    from xeric.sources import remote

    def fetch(offset):
        import json

        return json.dumps([{"day": f"d{i}", "v": i + offset / 1000} for i in range(max(0, offset - 1), min(offset + 10, 25))])

    got = {r["day"]: r["v"] for r in remote.read_pages(spark, fetch, 25, "day string, v double", 10, ["day"]).collect()}
    assert len(got) == 25 and got["d9"] == 9.0 and got["d20"] == 20.02
    calls = []

    def flaky(offset):
        calls.append(offset)
        if len(calls) < 3:
            raise OSError("busy")
        return "[]"

    assert remote.with_retries(flaky, 3, 0.0)(4) == "[]" and calls == [4, 4, 4]
    with pytest.raises(OSError):
        calls.clear()
        remote.with_retries(flaky, 2, 0.0)(4)
    html = "<table><TR><th>Month</th><th>mm</th></TR><tr class=a><td><b>Jan</b></td><td> 5 </td></tr><tr><td>only</td></tr></table>"
    rows = remote.html_table(spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "page int, html string"), "page", ["month", "mm"]).collect()
    assert [(r["page"], r["month"], r["mm"]) for r in rows] == [(1, "Month", "mm"), (1, "Jan", "5")]
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(t, 1.0) for t in months(36)], "month date, value double")

    for _ in range(2):
        assert remote.cached_index(spark, str(tmp_path / "index"), make, 1981, 1981).count() == 12
    assert made == [1]
    remote.write_csv(make(), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 36


def test_heterogeneity_tells_like_sites_from_unlike():
    r = np.random.default_rng(10)

    def lcv(x):
        l1, l2, *_ = K.l_moments(np.sort(x))
        return l2 / l1

    like = [lcv(r.gamma(3, 1, 40)) for _ in range(12)]
    unlike = [lcv(r.gamma(k, 1, 40)) for k in [0.5] * 6 + [12] * 6]
    assert abs(R.heterogeneity([40] * 12, like)) < 2 < 5 < R.heterogeneity([40] * 12, unlike) and np.isnan(R.heterogeneity([40], like[:1]))
    assert [R.shrink_weight(h) for h in (0.0, 0.8, 1.0, 1.2, 3.0, np.nan)] == pytest.approx([1, 1, 0.5, 0, 0, 0])


def test_regional_index_between_region_and_site(spark):
    r = np.random.default_rng(12)
    x = r.gamma(3, 2, 60)
    ref = np.ones(60, bool)
    local, _ = K.spi(x, ref, 15, 15, 5.0)
    whole, m1 = R.regional_index(x, ref, 0.3, 1.0)
    half, m6 = R.regional_index(x, ref, 0.3, 0.5)
    none, m3 = R.regional_index(x, ref, 0.3, 0.0)
    assert (m1, m6, m3) == (1, 6, 3) and np.allclose(none, local)
    assert ((half >= np.minimum(whole, local) - 1e-9) & (half <= np.maximum(whole, local) + 1e-9)).all()
    rows = [(s, s % 2, t, float(v) if i % 9 else None) for s in range(6) for i, (t, v) in enumerate(zip(months(240), r.gamma(3, 2, 240), strict=True))]
    d = spark.createDataFrame(rows, "site int, region int, month date, k_value double")
    got = risk.regional_index(d, ["region"], "site", 1980, 1999).collect()
    assert len(got) == len(rows) and {g["method"] for g in got} <= {0, 1, 3, 6} and abs(np.mean([g["z"] for g in got if g["z"] is not None])) < 0.1


def test_joint_places_by_hand():
    u = np.array([[0.2, 0.4], [0.4, 0.2], [0.6, 0.6], [0.8, 0.8]])
    base, place, share = R.joint_places(u)
    assert base.tolist() == [0.25, 0.25, 0.75, 1.0] and place.tolist() == [0.4, 0.4, 0.6, 0.8]
    assert np.allclose(np.abs(share).sum(1), 1) and share[3].tolist() == [-0.5, -0.5]
