"""Kernels against known values and plain versions."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest

from xeric.functions import kernels as K


def test_incomplete_gamma_and_beta():
    assert K.gamma_p(1.0, [0.5, 2, 10]) == pytest.approx([1 - math.exp(-v) for v in (0.5, 2, 10)], abs=1e-12)
    assert K.gamma_p(0.5, [1.0])[0] == pytest.approx(math.erf(1.0), abs=1e-12)
    assert K.beta_i(2, 3, [0.4])[0] == pytest.approx(0.5248, abs=1e-12)  # sum of binomials
    assert K.beta_i(1, 1, [0.25, 0.75]) == pytest.approx([0.25, 0.75], abs=1e-12)
    assert K.chi2_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05), abs=1e-6)


def test_l_moments_of_a_small_sample():
    l1, l2, t3, t4 = K.l_moments([1, 2, 3, 4, 5])
    assert (l1, l2) == pytest.approx((3, 1)) and (t3, t4) == pytest.approx((0, 0), abs=1e-12)


@pytest.mark.parametrize("name", ["glo", "pe3", "gev"])
def test_fits_recover_the_distribution(name):
    fit, cdf = K.FITS[name]
    x = np.random.default_rng(1).gamma(5, 2, 4000) if name != "glo" else np.random.default_rng(1).logistic(3, 2, 4000)
    par = fit(*K.l_moments(x)[:3])
    p = cdf(np.sort(x), par)
    assert (np.diff(p) >= -1e-12).all() and abs(p - (np.arange(4000) + 0.5) / 4000).max() < 0.03


def test_gamma_fit():
    a, b = K.fit_gamma(*K.l_moments(np.random.default_rng(2).gamma(3, 2, 20000))[:2])
    assert a == pytest.approx(3, rel=0.05) and b == pytest.approx(2, rel=0.05)


def test_spi_methods():
    x = np.random.default_rng(3).gamma(2, 50, 40)
    z, m = K.spi(x)
    assert m == 1 and abs(np.nanmean(z)) < 0.1 and 0.85 < np.nanstd(z) < 1.15 and (np.argsort(z) == np.argsort(x)).all()
    assert K.spi(np.full(10, 3.0)) [1] == 3
    z, m = K.spi(np.array([0, 0, 0, 0, 5.0, 7]))
    assert m == 2 and z[0] == z[1] == pytest.approx(NormalDist().inv_cdf((2.5 - 0.44) / 6.12))
    assert K.spi(np.array([1.0, 2, np.nan]))[1] == 0
    x[3] = np.nan
    assert np.isnan(K.spi(x)[0][3])


def test_spei_and_soil():
    x = np.random.default_rng(4).normal(0, 30, 60)
    z, family = K.spei(x)
    assert family in K.FITS and abs(z.mean()) < 0.1
    share = 1 / (1 + np.exp(-x / 30))
    for f in (K.ssi_soil, K.ssmi_soil):
        z = f(share)
        assert (np.argsort(z) == np.argsort(share)).all() and abs(z.mean()) < 0.15


def test_mann_kendall_by_hand():
    s, var, z = K.mann_kendall(np.array([1.0, 3, 2, 4]))
    assert s == 4 and var == pytest.approx(4 * 3 * 13 / 18) and z == pytest.approx(4 / math.sqrt(var))
    s, var, _ = K.mann_kendall(np.array([1.0, 1, 2]))
    assert s == 2 and var == pytest.approx((3 * 2 * 11 - 2 * 1 * 9) / 18)
    assert K.sen_slope(np.array([0.0, 2, 4, 6])) == 2


def test_trend_variants_see_a_trend_and_none():
    r = np.random.default_rng(5)
    flat, steep = r.normal(size=80), r.normal(size=80) + 0.05 * np.arange(80)
    for f in (K.corrected_mk, K.prewhitened_mk, lambda x: K.prewhitened_mk(x, always=False)):
        assert f(steep)[1] < 0.01 and f(flat)[1] > 0.05


def best_partition(x, beta):
    n = len(x)
    cost = lambda a, b: ((x[a:b] - x[a:b].mean()) ** 2).sum()
    f, last = [-beta] + [0.0] * n, [0] * (n + 1)
    for t in range(1, n + 1):
        f[t], last[t] = min((f[s] + cost(s, t) + beta, s) for s in range(t))
    out, t = [], n
    while last[t]:
        out.append(last[t])
        t = last[t]
    return out[::-1]


def test_pelt_is_the_exact_search():
    r = np.random.default_rng(6)
    for _ in range(10):
        x = np.concatenate([r.normal(m, 1, r.integers(5, 25)) for m in r.integers(-3, 4, 4)])
        y = (x - x.mean()) / x.std(ddof=1)
        assert K.pelt_mean(x, 1.5) == best_partition(y, 1.5)


def test_spectrum_finds_a_cycle():
    t = np.arange(480)
    x = np.sin(2 * math.pi * t / 48) + 0.3 * np.random.default_rng(7).normal(size=480)
    peaks = K.spectral_peaks(x)
    assert any(abs(p - 48) < 4 for p, _ in peaks)


def test_gap_filling():
    t = np.arange(40)
    x = 10 + np.sin(t / 6)
    y = x.copy()
    y[[0, 1, 10, 11, 12, 39]] = np.nan
    z = K.monotone_fill(t, y)
    assert np.isnan(z[[0, 1, 39]]).all() and z[10:13] == pytest.approx(x[10:13], abs=0.1)
    y[5:25] = np.nan
    assert np.isnan(K.monotone_fill(t, y)[5:25]).all()


@pytest.mark.parametrize("family", ["clayton", "gumbel", "frank", "joe"])
def test_copulas(family):
    p = K.archimedean_parameter(family, 0.4)
    g = (np.arange(60) + 0.5) / 60
    u, v = np.meshgrid(g, g)
    d = np.exp(K.copula_log_density(family, p, u.ravel(), v.ravel()))
    assert d.mean() == pytest.approx(1, abs=0.06)
    t = np.linspace(0.01, 0.99, 50)
    k = K.kendall_cdf(family, p, t)
    assert (k >= t - 1e-9).all() and (np.diff(k) > 0).all()
    # tau = 4 * integral of (1 - K) - 1
    grid = (np.arange(20000) + 0.5) / 20000
    assert 3 - 4 * K.kendall_cdf(family, p, grid).mean() == pytest.approx(0.4, abs=0.01)


def test_independence_copula():
    assert K.kendall_cdf("independence", 0.0, np.array([0.5]))[0] == pytest.approx(0.5 - 0.5 * math.log(0.5), abs=0.005)


def test_copula_choice():
    r = random.Random(1)
    u, v = [], []
    for _ in range(800):  # Clayton at 3
        a, w = r.random(), r.random()
        u.append(a)
        v.append(((w ** (-3 / 4) - 1) * a**-3 + 1) ** (-1 / 3))
    family, p, _, _ = K.fit_copula(np.array(u), np.array(v))
    assert family == "clayton" and p == pytest.approx(3, abs=0.5)


def test_components_and_errors():
    r = np.random.default_rng(9)
    base = r.normal(size=200)
    x = base[:, None] * np.ones(5) + 0.2 * r.normal(size=(200, 5))
    scores, patterns, share = K.principal_components(x, np.ones(5), 2)
    assert share[0] > 0.9 and patterns[:, 0].sum() > 0 and abs(np.corrcoef(scores[:, 0], base)[0, 1]) > 0.98
    t = np.arange(300.0)
    slope, se = K.newey_west(t, 2 * t + r.normal(size=300))
    assert slope == pytest.approx(2, abs=0.01) and 0 < se < 0.01
    lo, hi = K.block_bootstrap_mean(r.normal(5, 1, 200))
    assert lo < 5 < hi


def test_margins_and_intervals():
    r = np.random.default_rng(3)
    assert K.best_margin(r.gamma(1.2, 3, 3000))[0] == "gamma"
    assert K.best_margin(np.exp(r.normal(0, 1, 3000)))[0] == "lnorm"
    assert K.best_margin(r.normal(0, 1, 3000))[0] == "norm"
    low, high = K.poisson_interval(10, 50)
    assert low == pytest.approx(50 / 18.390, rel=1e-3) and high == pytest.approx(50 / 4.795, rel=1e-3)
    assert K.poisson_interval(0, 50)[1] == np.inf
