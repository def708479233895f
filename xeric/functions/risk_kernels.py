"""Numeric kernels of one bounded record: choice of distributions by L-moments, copula curves, moving dependence."""

from __future__ import annotations

from math import erf, exp, pi, sqrt

import numpy as np

from . import kernels as K

#: Rational approximation of the generalised normal's shape by L-skewness (Hosking, 1990s routines).
NORMAL_SHAPE = ((2.0466534, -3.6544371, 1.8396733, -0.20360244), (1.0, -2.0182173, 1.2420401, -0.21741801))
#: L-kurtosis of each family as a polynomial in its L-skewness, by power (Hosking and Wallis, 1997).
KURTOSIS = {
    "glo": (1 / 6, 0.0, 5 / 6),
    "gev": (0.10701, 0.11090, 0.84838, -0.06669, 0.00567, -0.04208, 0.03763),
    "gpa": (0.0, 0.20196, 0.95924, -0.20096, 0.04061),
    "ln3": (0.12282, 0.0, 0.77518, 0.0, 0.12279, 0.0, -0.13638, 0.0, 0.11368),
    "pe3": (0.12240, 0.0, 0.30115, 0.0, 0.95812, 0.0, -0.57488, 0.0, 0.19383),
}


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * (1 + erf(v / sqrt(2))) for v in np.ravel(x)]).reshape(np.shape(x))


def fit_gpa(l1: float, l2: float, t3: float) -> tuple[float, float, float]:
    """Location, scale and shape of the generalised Pareto distribution."""
    k = (1 - 3 * t3) / (1 + t3)
    return l1 - (2 + k) * l2, (1 + k) * (2 + k) * l2, k


def cdf_gpa(x: np.ndarray, par: tuple[float, float, float]) -> np.ndarray:
    loc, scale, k = par
    z = np.maximum(0, (x - loc) / scale)
    return 1 - np.exp(-z) if abs(k) < 1e-8 else 1 - np.maximum(0, 1 - k * z) ** (1 / k)


def fit_ln3(l1: float, l2: float, t3: float) -> tuple[float, float, float]:
    """Location, scale and shape of the generalised normal, which is the three-parameter log-normal."""
    up, down = (sum(c * t3 ** (2 * i) for i, c in enumerate(row)) for row in NORMAL_SHAPE)
    k = -t3 * up / down
    if abs(k) < 1e-8:
        return l1, l2 * sqrt(pi), 0.0
    scale = l2 * k * exp(-k * k / 2) / (1 - 2 * K.norm_cdf(-k / sqrt(2)))
    return l1 - scale / k * (1 - exp(k * k / 2)), scale, k


def cdf_ln3(x: np.ndarray, par: tuple[float, float, float]) -> np.ndarray:
    loc, scale, k = par
    z = (x - loc) / scale
    return normal_cdf(z if abs(k) < 1e-8 else -np.log(np.maximum(1e-300, 1 - k * z)) / k)


def fit_weibull(l1: float, l2: float, t3: float) -> tuple[float, float, float]:
    """A Weibull distribution is a GEV distribution of the negated values."""
    return K.fit_gev(-l1, l2, -t3)


def cdf_weibull(x: np.ndarray, par: tuple[float, float, float]) -> np.ndarray:
    return 1 - K.cdf_gev(-x, par)


def _ceiling(name: str, par: tuple[float, float, float]) -> float:
    """The largest value that a fitted distribution allows."""
    if name in ("gev", "glo", "ln3", "gpa") and par[2] > 1e-8:
        return par[0] + par[1] / par[2]
    return np.inf


FLOW = {"gev": (K.fit_gev, K.cdf_gev), "pe3": (K.fit_pe3, K.cdf_pe3), "ln3": (fit_ln3, cdf_ln3), "glo": (K.fit_glo, K.cdf_glo), "gpa": (fit_gpa, cdf_gpa), "weibull": (fit_weibull, cdf_weibull)}


def flow_family(v: np.ndarray) -> tuple[str, tuple[float, float, float], float] | None:
    """The family nearest to the sample in L-kurtosis at its L-skewness, its parameters and the distance.

    Fits with a ceiling below the largest value are out, and so are those without finite parameters. Earlier ones win ties.
    """
    l1, l2, t3, t4 = K.l_moments(v)
    if not l2 > 0:
        return None
    best = None
    for name, (fit, cdf) in FLOW.items():
        curve, skew = KURTOSIS["gev" if name == "weibull" else name], -t3 if name == "weibull" else t3
        away = abs(sum(c * skew**i for i, c in enumerate(curve)) - t4)
        try:
            par = tuple(float(p) for p in fit(l1, l2, t3))
            ok = np.isfinite(par).all() and par[1] > 0 and _ceiling(name, par) >= v.max() and np.isfinite(cdf(v, par)).all()
        except (ValueError, ZeroDivisionError, OverflowError):
            continue
        if ok and (best is None or away < best[2] - 1e-12):
            best = (name, par, float(away))
    return best


def streamflow_index(x: np.ndarray, least: int = 10, limit: float = 5.0) -> tuple[np.ndarray, str | None]:
    """Standardised streamflow of one calendar month: fitted on positive flows, applied to all; null under ``least`` values."""
    x = np.asarray(x, float)
    out = np.full(len(x), np.nan)
    ok = np.isfinite(x)
    v = x[ok & (x > 0)]
    best = flow_family(v) if len(v) >= least else None
    if best is None:
        return out, None
    p = FLOW[best[0]][1](x[ok], best[1])
    out[ok] = np.clip(K.norm_quantile(np.clip(p, 1e-6, 1 - 1e-6)), -limit, limit)
    return out, best[0]


def gev_return_period(maxima: np.ndarray, value: float) -> float:
    """Years between values as large, by a GEV distribution of the yearly maxima (L-moments)."""
    if len(maxima) < 5:
        return np.nan
    l1, l2, t3, _ = K.l_moments(np.sort(maxima))
    if not l2 > 0:
        return np.nan
    p = float(K.cdf_gev(np.array([value]), K.fit_gev(l1, l2, t3))[0])
    return 1 / (1 - p) if p < 1 else np.inf


def renewal_target(years: float, gap_months: float, cv: float) -> float:
    """The copula level at a return period: 1 - gap / (12 T) for near-Poisson gaps, else by a gamma renewal process.

    Gaps whose coefficient of variation is within 0.5 to 1.5, or is unknown, count as Poisson.
    """
    if not np.isfinite(cv) or cv <= 0 or 0.5 <= cv <= 1.5:
        return 1 - gap_months / (12 * years)
    shape = 1 / cv**2
    happened = float(K.gamma_p(shape, np.array([shape / (gap_months / 12) * years]))[0])
    return float(np.clip(1 - happened / years / 12, 1e-9, 1 - 1e-9))


def copula_cdf(family: str, p: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """C(u, v) of the one-parameter Archimedean families, else of independence."""
    if family == "clayton":
        return (u**-p + v**-p - 1) ** (-1 / p)
    if family == "gumbel":
        return np.exp(-(((-np.log(u)) ** p + (-np.log(v)) ** p) ** (1 / p)))
    if family == "frank":
        return -np.log1p(np.expm1(-p * u) * np.expm1(-p * v) / np.expm1(-p)) / p
    if family == "joe":
        a, b = (1 - u) ** p, (1 - v) ** p
        return 1 - (a + b - a * b) ** (1 / p)
    return u * v


def kendall_return_periods(x: np.ndarray, y: np.ndarray, gap_months: float) -> tuple[str, np.ndarray]:
    """Years between pairs at least as deep, by the Kendall function of the Archimedean copula of the ranks."""
    n = len(x)
    u, v = K.average_ranks(x) / (n + 1), K.average_ranks(y) / (n + 1)
    family, p, *_ = K.fit_copula(u, v)
    if family in ("gaussian", "independence"):
        family, p = "frank", K.archimedean_parameter("frank", float(np.clip(K.kendall_tau(u, v), 0.02, 0.94)))
    beyond = 1 - K.kendall_cdf(family, p, np.clip(copula_cdf(family, p, u, v), 1e-9, 1 - 1e-9))
    return family, np.where(beyond > 0, gap_months / 12 / np.maximum(beyond, 1e-12), np.inf)


def conditional_level(family: str, p: float, u: np.ndarray, v: float) -> np.ndarray:
    """P(U <= u | V = v) under a copula: its derivative by v."""
    u = np.clip(u, 1e-9, 1 - 1e-9)
    if family == "clayton":
        return v ** (-p - 1) * (u**-p + v**-p - 1) ** (-1 / p - 1)
    if family == "gumbel":
        a, b = -np.log(u), -np.log(v)
        s = (a**p + b**p) ** (1 / p)
        return np.exp(-s) * s ** (1 - p) * b ** (p - 1) / v
    if family == "frank":
        a, b, c = np.expm1(-p * u), np.expm1(-p * v), np.expm1(-p)
        return a * np.exp(-p * v) / (c + a * b)
    if family == "joe":
        a, b = (1 - u) ** p, (1 - v) ** p
        return (a + b - a * b) ** (1 / p - 1) * (1 - v) ** (p - 1) * (1 - a)
    if family == "gaussian":
        x, y = K.norm_quantile(u), float(K.norm_quantile(np.array([v]))[0])
        return normal_cdf((x - p * y) / sqrt(1 - p * p))
    return u


def conditional_severity(family: str, p: float, target: float, v: float) -> float:
    """The u at which the conditional level given v reaches the target, by bisection."""
    low, high = 1e-9, 1 - 1e-9
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if conditional_level(family, p, np.array([mid]), v)[0] < target else (low, mid)
    return (low + high) / 2


def saf_curves(severity: np.ndarray, area: np.ndarray, gap_months: float, cv: float, years=(10, 25, 50, 100), areas=tuple(range(5, 100, 5))) -> list[tuple[float, float, float, str]]:
    """Severity by return period and area share: (years, area %, severity, family) of the conditional copula.

    Margins: a gamma distribution for severity and the empirical distribution for area; the copula is fitted on ranks.
    """
    n = len(severity)
    if n < 10 or np.ptp(severity) <= 0 or np.ptp(area) <= 0:
        return []
    l1, l2, *_ = K.l_moments(np.sort(severity))
    shape, scale = K.fit_gamma(l1, l2)
    family, p, *_ = K.fit_copula(K.average_ranks(severity) / (n + 1), K.average_ranks(area) / (n + 1))
    edges = np.sort(area)
    out = []
    for t in years:
        target = renewal_target(t, gap_months, cv)
        if not 0 < target < 1:
            continue
        for a in areas:
            v = float(np.clip(np.searchsorted(edges, a, side="right") / (n + 1), 0.5 / (n + 1), n / (n + 1)))
            u = conditional_severity(family, p, target, v)
            low, high = 0.0, float(severity.max()) * 50
            for _ in range(80):
                mid = (low + high) / 2
                low, high = (mid, high) if K.gamma_p(shape, np.array([mid / scale]))[0] < u else (low, mid)
            out.append((float(t), float(a), (low + high) / 2, family))
    return out


def pettitt(x: np.ndarray) -> tuple[int, float]:
    """The place of the largest rank shift and its p."""
    n = len(x)
    k = np.cumsum(2 * K.average_ranks(x) - (n + 1))[:-1]
    at = int(np.abs(k).argmax())
    return at, float(min(1.0, 2 * np.exp(-6 * k[at] ** 2 / (n**3 + n**2))))


def cusum_permutation(x: np.ndarray, draws: int = 499, seed: int = 123) -> tuple[int, float]:
    """The place of the largest cumulated departure and the share of permutations with one as large."""
    z = (x - x.mean()) / (x.std(ddof=1) if x.std(ddof=1) >= 1e-10 else 1.0)
    c = np.abs(np.cumsum(z))
    rng = np.random.Generator(np.random.PCG64(seed))
    top = np.array([np.abs(np.cumsum(rng.permutation(z))).max() for _ in range(draws)])
    return int(c.argmax()), float((top >= c.max() - 1e-12).mean())


def copula_split(u: np.ndarray, v: np.ndarray, shares=(0.2, 0.35, 0.5, 0.65, 0.8)) -> tuple[int, float]:
    """The split with the largest gain of likelihood for a copula of its own on either side, and its chi-square(1) p.

    The p isn't corrected for the choice among splits, so it is too small; the consensus asks for a second test.
    """
    family, p, *_ = K.fit_copula(u, v)
    if family == "independence":
        return -1, 1.0

    def best(a: np.ndarray, b: np.ndarray) -> float:
        tau = min(max(K.kendall_tau(a, b), 0.02 if family != "gaussian" else -0.95), 0.94)
        with np.errstate(all="ignore"):
            value = float(np.sum(K.copula_log_density(family, K.archimedean_parameter(family, tau), a, b)))
        return value if np.isfinite(value) else -np.inf

    whole, found = best(u, v), (-1, 0.0)
    for s in shares:
        k = int(round(s * len(u)))
        if 5 <= k <= len(u) - 5:
            gain = 2 * (best(u[:k], v[:k]) + best(u[k:], v[k:]) - whole)
            if gain > found[1]:
                found = (k - 1, gain)
    return found[0], float(2 * (1 - K.norm_cdf(sqrt(max(0.0, found[1])))))


def consensus_change(tau: np.ndarray, years: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple:
    """(Pettitt year, p, CUSUM year, p, copula year, p, detected, year): at least two of three with p < 0.05.

    ``tau`` is a series of rolling tau (null where it has none), ``u`` and ``v`` the ranks it was taken from.
    """
    ok = np.isfinite(tau)
    if ok.sum() < 10:
        return (None, None) * 3 + (False, None)
    x, y = tau[ok], years[ok]
    (a, pa), (b, pb), (c, pc) = pettitt(x), cusum_permutation(x), copula_split(u, v)
    tests = [(int(y[a]), pa), (int(y[b]), pb), (int(years[c]) if c >= 0 else None, pc)]
    hit = [t for t, p in tests if p < 0.05 and t is not None]
    return (*(z for t in tests for z in t), len(hit) >= 2, int(round(float(np.median(hit)))) if len(hit) >= 2 else None)


def white_noise_envelope(x: np.ndarray, draws: int = 300, level: float = 0.95, seed: int = 7) -> list[tuple[float, float, bool]]:
    """(period, power, outside): the smoothed spectrum beside the level that white noise of its variance stays under."""
    f, p = K.spectrum(x)
    rng = np.random.Generator(np.random.PCG64(seed))
    noise = np.array([K.spectrum(rng.normal(0, x.std(), len(x)))[1] for _ in range(draws)])
    line = np.quantile(noise, level, axis=0)
    return [(float(1 / f[i]), float(p[i]), bool(p[i] > line[i])) for i in range(len(f)) if f[i] > 0]


def moderated_mediation(x: np.ndarray, w: np.ndarray, m: np.ndarray, y: np.ndarray, draws: int = 200, block: float = 6.0, seed: int = 5) -> dict[str, float]:
    """Two regressions with a moderator: m on x, w, xw; y on m, x, w, mw. Centred; indirect effects at w = -1, 0, 1.

    The interval of the middle effect comes from a stationary bootstrap with geometric blocks of mean length ``block``.
    """
    x, w, m, y = (z - z.mean() for z in (x, w, m, y))
    n = len(x)
    if n < 12:
        return {}

    def paths(i: np.ndarray) -> dict[str, float] | None:
        one = np.ones(len(i))
        a = np.linalg.lstsq(np.stack([one, x[i], w[i], x[i] * w[i]], 1), m[i], rcond=None)[0]
        b = np.linalg.lstsq(np.stack([one, m[i], x[i], w[i], m[i] * w[i]], 1), y[i], rcond=None)[0]
        out = {f"indirect_{k}": float((a[1] + a[3] * v) * (b[1] + b[4] * v)) for k, v in (("low", -1), ("mid", 0), ("high", 1))}
        total = float(b[2] + a[1] * b[1])
        return out | {"direct": float(b[2]), "total": total, "share": out["indirect_mid"] / total if total else np.nan, "moderation": float(a[3] * b[1] + a[1] * b[4] + a[3] * b[4])}

    rng = np.random.Generator(np.random.PCG64(seed))
    mids = []
    for _ in range(draws):
        new = rng.random(n) < 1 / block
        new[0] = True
        start = np.where(new, rng.integers(0, n, n), 0)
        run = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        mids.append(paths((start[np.maximum.accumulate(np.where(new, np.arange(n), 0))] + run) % n)["indirect_mid"])
    return paths(np.arange(n)) | {"mid_low": float(np.quantile(mids, 0.025)), "mid_high": float(np.quantile(mids, 0.975))}


def vine_order(tau: np.ndarray) -> list[int]:
    """Variables in a chain: the strongest pair first, then each time the one most tied to either end, at that end."""
    t = np.abs(np.nan_to_num(tau))
    np.fill_diagonal(t, 0)
    if len(t) < 2:
        return list(range(len(t)))
    upper = np.triu(t, 1)
    # Of equal pairs the first by column, then row.
    j, i = np.unravel_index(int(upper.T.argmax()), t.shape)
    chain, rest = [int(i), int(j)], [k for k in range(len(t)) if k not in (i, j)]
    while rest:
        k = max(rest, key=lambda r: (max(t[r, chain[0]], t[r, chain[-1]]), -r))
        rest.remove(k)
        chain = [k, *chain] if t[k, chain[0]] >= t[k, chain[-1]] else [*chain, k]
    return chain


def heterogeneity(lengths: np.ndarray, lcv: np.ndarray, draws: int = 200, seed: int = 123) -> float:
    """H: how far the spread of sites' L-CV is above that of homogeneous sites, in standard deviations of simulations.

    Sites are simulated with their own record lengths from a gamma distribution of the pooled L-CV (no kappa is fitted).
    """
    lengths, lcv = np.asarray(lengths, int), np.asarray(lcv, float)
    if len(lengths) < 2:
        return np.nan
    w = lengths / lengths.sum()
    mean = float((w * lcv).sum())
    if not 0 < mean < 1:
        return np.nan
    shape, scale = K.fit_gamma(1.0, mean)
    rng = np.random.Generator(np.random.PCG64(seed))
    spread = lambda t: np.sqrt((w * (t - (w * t).sum(-1, keepdims=True)) ** 2).sum(-1))
    sim = np.empty((draws, len(lengths)))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        x = np.sort(rng.gamma(shape, scale, (draws, len(at), n)), axis=2)
        b0, b1 = x.mean(2), (x * np.arange(n)).mean(2) / (n - 1)
        sim[:, at] = (2 * b1 - b0) / b0
    v = spread(sim)
    return float((spread(lcv[None])[0] - v.mean()) / v.std(ddof=1))


def shrink_weight(h: float, threshold: float = 1.0, band: float = 0.2) -> float:
    """How much of the regional fit is taken: all below the band around the threshold, none above it."""
    return float(np.clip((threshold + band - h) / (2 * band), 0, 1)) if np.isfinite(h) else 0.0


def regional_index(x: np.ndarray, reference: np.ndarray, lcv: float, weight: float, least: int = 15, limit: float = 5.0) -> tuple[np.ndarray, int]:
    """Index of one calendar month from the region's gamma distribution of x / mean, blended with the local fit.

    Method 1 regional, 6 blended, local ones plus 2 (3 gamma, 4 ranks, 5 constant), 0 none.
    """
    ok = np.isfinite(x)
    mean = x[ok & reference].mean() if (ok & reference).any() else np.nan
    local, method = K.spi(x, reference, least, least, limit)
    if not (mean > 0 and 0 < lcv < 1 and weight > 0):
        return local, method + 2 if method else 0
    shape, scale = K.fit_gamma(1.0, lcv)
    p0 = float((x[ok & reference] <= 0).mean())
    p = np.where(x[ok] > 0, p0 + (1 - p0) * K.gamma_p(shape, np.maximum(x[ok], 0) / mean / scale), p0)
    if weight < 1 - 1e-9:
        own = local[ok]
        p = np.where(np.isfinite(own), weight * p + (1 - weight) * normal_cdf(np.nan_to_num(own)), p)
    out = np.full(len(x), np.nan)
    out[ok] = np.clip(K.norm_quantile(np.clip(p, 1e-6, 1 - 1e-6)), -limit, limit)
    return out, 1 if weight >= 1 - 1e-9 else 6


def joint_places(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of pseudo-observations: the empirical copula, its Kendall place, and each variable's contribution.

    The copula is the share of rows at or below in all variables; a row's place is the share of rows whose copula is at
    or below its own, over n + 1. A contribution is what the copula gains if the variable is set to 0.5, over the sum of
    absolute gains.
    """
    n, d = u.shape

    def copula(at: np.ndarray) -> np.ndarray:
        return np.array([(u <= a).all(1).sum() for a in at]) / n

    base = copula(u)
    place = np.searchsorted(np.sort(base), base, side="right") / (n + 1)
    gains = np.empty((n, d))
    for k in range(d):
        neutral = u.copy()
        neutral[:, k] = 0.5
        gains[:, k] = copula(neutral) - base
    total = np.abs(gains).sum(1)
    return base, place, gains / np.where(total == 0, 1, total)[:, None]
