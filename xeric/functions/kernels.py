"""Numeric kernels in numpy: distributions by L-moments, series tests, spectra. One series in, one result out."""

from __future__ import annotations

from math import erf, lgamma, log, pi, sqrt

import numpy as np

EULER = 0.5772156649015329


def norm_cdf(x: float) -> float:
    return 0.5 * (1 + erf(x / sqrt(2)))


def norm_cdfs(x: np.ndarray) -> np.ndarray:
    """The normal distribution function of an array, to 1e-15: erfc by its values at the distinct arguments."""
    values, at = np.unique(np.ravel(x), return_inverse=True)
    return np.array([norm_cdf(v) for v in values.tolist()])[at].reshape(np.shape(x))


def norm_quantile(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    inv = NormalDist().inv_cdf
    return np.array([inv(float(v)) if 0 < v < 1 else np.nan for v in np.atleast_1d(p)])


def gamma_p(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    x = np.atleast_1d(np.asarray(x, float))
    out = np.zeros_like(x)
    for i, v in enumerate(x):
        if v <= 0:
            continue
        front = np.exp(-v + a * log(v) - lgamma(a))
        if v < a + 1:
            term = total = 1 / a
            k = a
            while abs(term) > abs(total) * 1e-15:
                k += 1
                term *= v / k
                total += term
            out[i] = total * front
        else:
            b, c, d = v + 1 - a, 1e300, 1 / (v + 1 - a)
            h = d
            for n in range(1, 1000):
                an = -n * (n - a)
                b += 2
                d = an * d + b
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = b + an / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            out[i] = 1 - front * h
    return out


def beta_i(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    def fraction(a: float, b: float, v: float) -> float:
        c, d = 1.0, 1 - (a + b) * v / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * v / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * v / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + num / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    out = []
    for v in np.atleast_1d(np.asarray(x, float)):
        if v <= 0 or v >= 1:
            out.append(0.0 if v <= 0 else 1.0)
            continue
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(v) + b * log(1 - v))
        out.append(front * fraction(a, b, v) / a if v < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - v) / b)
    return np.array(out)


def l_moments(x: np.ndarray) -> tuple[float, float, float, float]:
    """l1, l2, t3, t4 of a sample of at least 4."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    i = np.arange(1, n + 1)
    w1 = (i - 1) / (n - 1)
    w2 = w1 * (i - 2) / (n - 2)
    w3 = w2 * (i - 3) / (n - 3)
    b0, b1, b2, b3 = x.mean(), (w1 * x).mean(), (w2 * x).mean(), (w3 * x).mean()
    l2 = 2 * b1 - b0
    if l2 <= 0:
        return b0, l2, np.nan, np.nan
    return b0, l2, (6 * b2 - 6 * b1 + b0) / l2, (20 * b3 - 30 * b2 + 12 * b1 - b0) / l2


def fit_gamma(l1: float, l2: float) -> tuple[float, float]:
    """Shape and scale of a gamma distribution from its first two L-moments (Hosking's rational approximations)."""
    t = l2 / l1
    if t < 0.5:
        z = pi * t * t
        a = (1 - 0.3080 * z) / (z - 0.05812 * z**2 + 0.01765 * z**3)
    else:
        z = 1 - t
        a = (0.7213 * z - 0.5947 * z**2) / (1 - 2.1817 * z + 1.2113 * z**2)
    return a, l1 / a


def fit_glo(l1: float, l2: float, t3: float) -> tuple[float, float, float]:
    k = -t3
    if abs(k) < 1e-6:
        return l1, l2, 0.0
    s = l2 * np.sin(k * pi) / (k * pi)
    return l1 - s * (1 / k - pi / np.sin(k * pi)), s, k


def cdf_glo(x: np.ndarray, par: tuple[float, float, float]) -> np.ndarray:
    m, s, k = par
    y = (np.asarray(x, float) - m) / s
    if k:
        inside = 1 - k * y
        y = np.where(inside > 0, -np.log(np.maximum(inside, 1e-300)) / k, np.inf if k > 0 else -np.inf)
    return 1 / (1 + np.exp(-np.clip(y, -700, 700)))


def fit_gev(l1: float, l2: float, t3: float) -> tuple[float, float, float]:
    c = 2 / (3 + t3) - log(2) / log(3)
    k = 7.8590 * c + 2.9554 * c * c
    for _ in range(30):  # Newton on the exact relation
        f = 2 * (1 - 3.0**-k) / (1 - 2.0**-k) - 3 - t3 if abs(k) > 1e-9 else 2 * log(3) / log(2) - 3 - t3
        e = 1e-6
        g = 2 * (1 - 3.0 ** -(k + e)) / (1 - 2.0 ** -(k + e)) - 3 - t3
        step = f * e / (g - f) if g != f else 0.0
        k -= step
        if abs(step) < 1e-12:
            break
    if abs(k) < 1e-6:
        s = l2 / log(2)
        return l1 - s * EULER, s, 0.0
    g1 = np.exp(lgamma(1 + k)) if k > -1 else np.nan
    s = l2 * k / ((1 - 2.0**-k) * g1)
    return l1 - s * (1 - g1) / k, s, k


def cdf_gev(x: np.ndarray, par: tuple[float, float, float]) -> np.ndarray:
    m, s, k = par
    y = (np.asarray(x, float) - m) / s
    if k:
        inside = 1 - k * y
        y = np.where(inside > 0, -np.log(np.maximum(inside, 1e-300)) / k, np.inf if k > 0 else -np.inf)
    return np.exp(-np.exp(-np.clip(y, -700, 700)))


def fit_pe3(l1: float, l2: float, t3: float) -> tuple[float, float, float]:
    """Mean, standard deviation and skewness of a Pearson III distribution."""
    t = abs(t3)
    if t < 1e-6:
        return l1, l2 * sqrt(pi), 0.0
    if t < 1 / 3:
        z = 3 * pi * t * t
        a = (1 + 0.2906 * z) / (z + 0.1882 * z**2 + 0.0442 * z**3)
    else:
        z = 1 - t
        a = (0.36067 * z - 0.59567 * z**2 + 0.25361 * z**3) / (1 - 2.78861 * z + 2.56096 * z**2 - 0.77045 * z**3)
    sd = l2 * sqrt(pi * a) * np.exp(lgamma(a) - lgamma(a + 0.5))
    return l1, sd, 2 / sqrt(a) * np.sign(t3)


def cdf_pe3(x: np.ndarray, par: tuple[float, float, float]) -> np.ndarray:
    m, s, g = par
    x = np.asarray(x, float)
    if g == 0:
        return np.array([norm_cdf(v) for v in (x - m) / s])
    a, b = 4 / g**2, 0.5 * s * abs(g)
    y = (x - (m - 2 * s / g)) / b
    return gamma_p(a, y) if g > 0 else 1 - gamma_p(a, -y)


FITS = {"glo": (fit_glo, cdf_glo), "pe3": (fit_pe3, cdf_pe3), "gev": (fit_gev, cdf_gev)}


def ks_p(x: np.ndarray, cdf) -> float:
    """Asymptotic p of the Kolmogorov-Smirnov distance."""
    x = np.sort(x)
    n = len(x)
    f = cdf(x)
    d = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
    lam = (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d
    k = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k**2 * lam**2)).sum()))) if lam > 0.2 else 1.0


def average_ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.searchsorted(s, s, side="left")
    last = np.searchsorted(s, s, side="right")
    out = np.empty(len(x))
    out[order] = (first + 1 + last) / 2
    return out


def gringorten(x: np.ndarray) -> np.ndarray:
    return (average_ranks(x) - 0.44) / (len(x) + 0.12)


def spi(x: np.ndarray, reference: np.ndarray | None = None, least: int = 5, positives: int = 10, limit: float = 4.75) -> tuple[np.ndarray, int]:
    """Standardised precipitation of one calendar month's sums, and the method (1 gamma, 2 ranks, 3 constant, 0 none).

    A gamma distribution by L-moments on the positive values, with the zeros' share as a mass at 0; ranks if there are too
    few positives or hardly any variance. ``reference`` marks the values that are fitted on (all by default).
    """
    x = np.asarray(x, float)
    out = np.full(len(x), np.nan)
    ok = np.isfinite(x)
    use = ok if reference is None else ok & reference
    v = x[use]
    if len(v) < least:
        return out, 0
    spread = v.var(ddof=1)
    if spread < np.finfo(float).eps:
        out[ok] = 0.0
        return out, 3
    pos = v[v > 0]
    if spread >= 0.01 and len(pos) >= positives:
        l1, l2, *_ = l_moments(pos)
        if l2 > 0:
            shape, scale = fit_gamma(l1, l2)
            p0 = (v <= 0).mean()
            p = np.where(x[ok] > 0, p0 + (1 - p0) * gamma_p(shape, x[ok] / scale), p0)
            out[ok] = np.clip(norm_quantile(np.clip(p, 1e-6, 1 - 1e-6)), -limit, limit)
            return out, 1
    if reference is not None:
        return out, 0
    out[ok] = np.clip(norm_quantile(gringorten(v)), -limit, limit)
    return out, 2


def spei(x: np.ndarray, least: int = 5) -> tuple[np.ndarray, str | None]:
    """Standardised water balance: the best of GLO, PE3 and GEV by the p of the distance; earlier ones win ties."""
    x = np.asarray(x, float)
    out = np.full(len(x), np.nan)
    ok = np.isfinite(x)
    v = x[ok]
    if len(v) < least:
        return out, None
    if v.var(ddof=1) < np.finfo(float).eps:
        out[ok] = 0.0
        return out, "constant"
    l1, l2, t3, _ = l_moments(v)
    best = None
    for name, (fit, cdf) in FITS.items():
        try:
            par = fit(l1, l2, t3)
            p = ks_p(v, lambda s, par=par, cdf=cdf: cdf(s, par))
        except (ValueError, ZeroDivisionError, OverflowError):
            continue
        if np.isfinite(par).all() and (best is None or p > best[0]):
            best = (p, name, cdf(v, par))
    if best is None:
        return out, None
    out[ok] = norm_quantile(np.clip(best[2], 1e-6, 1 - 1e-6))
    return out, best[1]


def ssi_soil(x: np.ndarray) -> np.ndarray:
    """Soil moisture: a beta distribution by moments if they allow one, else ranks (r - 0.375) / (n + 0.25)."""
    x = np.asarray(x, float)
    out = np.full(len(x), np.nan)
    ok = np.isfinite(x)
    v = x[ok]
    if len(v) < 5:
        return out
    m, s = v.mean(), v.var(ddof=1)
    if 0 < m < 1 and 0 < s < m * (1 - m):
        c = m * (1 - m) / s - 1
        p = beta_i(m * c, (1 - m) * c, v)
    else:
        p = (average_ranks(v) - 0.375) / (len(v) + 0.25)
    out[ok] = norm_quantile(np.clip(p, 1e-6, 1 - 1e-6))
    return out


def ssmi_soil(x: np.ndarray) -> np.ndarray:
    """Soil moisture: the CDF of a Gaussian kernel density in logit space, rule-of-thumb bandwidth."""
    x = np.asarray(x, float)
    out = np.full(len(x), np.nan)
    ok = np.isfinite(x)
    v = x[ok]
    if len(v) < 5:
        return out
    if (v > 0).all() and (v < 1).all() and v.var() > 0:
        y = np.log(v / (1 - v))
        iqr = np.subtract(*np.percentile(y, [75, 25]))
        h = 0.9 * min(y.std(ddof=1), iqr / 1.34 if iqr > 0 else y.std(ddof=1)) * len(y) ** -0.2
        p = norm_cdfs((y[:, None] - y[None, :]) / h).mean(axis=1)
    else:
        p = (average_ranks(v) - 0.375) / (len(v) + 0.25)
    out[ok] = norm_quantile(np.clip(p, 1e-6, 1 - 1e-6))
    return out


def mann_kendall(x: np.ndarray) -> tuple[float, float, float]:
    """S, its variance with ties, and z without continuity correction."""
    n = len(x)
    i, j = np.triu_indices(n, 1)
    s = float(np.sign(x[j] - x[i]).sum())
    _, c = np.unique(x, return_counts=True)
    var = (n * (n - 1) * (2 * n + 5) - (c * (c - 1) * (2 * c + 5)).sum()) / 18
    return s, float(var), s / sqrt(var) if var > 0 else np.nan


def sen_slope(x: np.ndarray) -> float:
    i, j = np.triu_indices(len(x), 1)
    return float(np.median((x[j] - x[i]) / (j - i))) if len(i) else np.nan


def two_sided(z: float) -> float:
    return 2 * (1 - norm_cdf(abs(z))) if np.isfinite(z) else np.nan


def lag1(x: np.ndarray) -> float:
    d = x - x.mean()
    v = (d * d).sum()
    return float((d[1:] * d[:-1]).sum() / v) if v > 0 else 0.0


def corrected_mk(x: np.ndarray, least: int = 12) -> tuple[float, float, bool]:
    """z and p with Hamed and Rao's variance for the ranks' significant autocorrelations; whether |lag 1| > 0.1."""
    if len(x) < least or x.var() < 1e-6:
        return np.nan, np.nan, False
    s, var, _ = mann_kendall(x)
    n = len(x)
    d = average_ranks(x - sen_slope(x) * np.arange(n))
    d = d - d.mean()
    total, rho = (d * d).sum(), 0.0
    for k in range(1, n - 2):
        r = (d[k:] * d[:-k]).sum() / total
        if abs(r) > 1.96 / sqrt(n):
            rho += (n - k) * (n - k - 1) * (n - k - 2) * r
    factor = max(1e-6, 1 + 2 / (n * (n - 1) * (n - 2)) * rho)
    z = s / sqrt(var * factor) if var > 0 else np.nan
    return z, two_sided(z), abs(lag1(x)) > 0.1


def prewhitened_mk(x: np.ndarray, always: bool = True) -> tuple[float, float, float, bool]:
    """Trend-free pre-whitening: z, p, Sen's slope and whether |r1| > 0.1; ``always`` or only in that case."""
    if len(x) < 4 or x.var() < 1e-12:
        return np.nan, np.nan, np.nan, False
    b = sen_slope(x)
    t = np.arange(len(x))
    d = x - b * t
    r = lag1(d)
    strong = abs(r) > 0.1
    y = x
    if always:
        y = d[1:] - r * d[:-1] + b * t[1:]
    elif strong:
        y = np.concatenate([d[:1], d[1:] - r * d[:-1]]) + b * t
    _, _, z = mann_kendall(y)
    return z, two_sided(z), b, strong


def pelt_mean(x: np.ndarray, penalty: float | None = None) -> list[int]:
    """Change points of the mean by pruned exact search.

    Costs are squared errors in units of the whole series' variance, known once for all segments; the penalty of a change
    is 2 log n of these by default: a mean and a place, log n each.
    """
    n = len(x)
    sd = x.std(ddof=1)
    if n < 4 or sd == 0:
        return []
    y = (x - x.mean()) / sd
    c1, c2 = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])
    beta = 2 * log(n) if penalty is None else penalty
    cost = lambda a, b: c2[b] - c2[a] - (c1[b] - c1[a]) ** 2 / (b - a)
    f, last, open_ = np.zeros(n + 1), np.zeros(n + 1, int), [0]
    f[0] = -beta
    for t in range(1, n + 1):
        v = [f[s] + cost(s, t) + beta for s in open_]
        k = int(np.argmin(v))
        f[t], last[t] = v[k], open_[k]
        open_ = [s for s, w in zip(open_, v, strict=True) if w - beta <= f[t]] + [t]
    out, t = [], n
    while last[t] > 0:
        out.append(int(last[t]))
        t = last[t]
    return out[::-1]


def _daniell(span: int) -> np.ndarray:
    k = np.ones(2 * (span // 2) + 1)
    k[0] = k[-1] = 0.5
    return k / k.sum()


def degrees_of_freedom(spans: tuple[int, ...] = (3, 5), taper: float = 0.1) -> float:
    """Of a smoothed and tapered spectrum: 2 / sum of squared weights, less what a cosine taper of that share costs."""
    k = np.ones(1)
    for s in spans:
        k = np.convolve(k, _daniell(s))
    return float(2 / (k * k).sum() * (1 - 5 / 8 * taper * 2) ** 2 / (1 - 93 / 128 * taper * 2))


def spectrum(x: np.ndarray, spans: tuple[int, ...] = (3, 5), taper: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and a smoothed periodogram after a linear detrend and a cosine taper (modified Daniell kernels)."""
    n = len(x)
    t = np.arange(n)
    y = x - np.polyval(np.polyfit(t, x, 1), t)
    m = int(n * taper)
    w = np.ones(n)
    if m:
        edge = 0.5 * (1 - np.cos(pi * (np.arange(m) + 0.5) / m))
        w[:m], w[-m:] = edge, edge[::-1]
    p = np.abs(np.fft.fft(y * w)) ** 2 / n / (w**2).mean()
    p[0] = (p[1] + p[-1]) / 2
    for s in spans:
        h, k = s // 2, _daniell(s)
        p = sum(k[i + h] * np.roll(p, i) for i in range(-h, h + 1))
    half = n // 2
    return np.arange(1, half + 1) / n, p[1 : half + 1]


def chi2_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, max(10.0, 10 * df)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(df / 2, mid / 2)[0] < p else (lo, mid)
    return (lo + hi) / 2


def spectral_peaks(x: np.ndarray, least_period: float = 24.0, level: float = 0.95) -> list[tuple[float, float]]:
    """(period, power) of the top of each run of frequencies above the AR(1) background at the given level.

    Only periods of ``least_period`` steps or more count, also for the scale of the background.
    """
    f, p = spectrum(x)
    keep = 1 / f >= least_period
    if not keep.any():
        return []
    f, p = f[keep], p[keep]
    r = float(np.clip(lag1(x - np.polyval(np.polyfit(np.arange(len(x)), x, 1), np.arange(len(x)))), -0.99, 0.99))
    red = (1 - r * r) / (1 + r * r - 2 * r * np.cos(2 * pi * f))
    red *= p.mean() / red.mean()
    df = degrees_of_freedom()
    above = p > red * chi2_quantile(level, df) / df
    cuts = np.flatnonzero(np.diff(np.concatenate([[0], above.astype(int), [0]])))
    tops = [a + int(p[a:b].argmax()) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    return [(float(1 / f[i]), float(p[i])) for i in tops]


def monotone_fill(t: np.ndarray, x: np.ndarray, longest: int = 14, context: int = 15) -> np.ndarray:
    """Fill inner gaps of up to ``longest`` steps by a monotone cubic through the values within ``context``; not below 0."""
    out = x.copy()
    bad = ~np.isfinite(x)
    i = 0
    while i < len(x):
        if not bad[i]:
            i += 1
            continue
        j = i
        while j < len(x) and bad[j]:
            j += 1
        if i > 0 and j < len(x) and j - i <= longest:
            near = np.arange(max(0, i - context), min(len(x), j + context))
            near = near[np.isfinite(x[near])]
            if len(near) >= 2:
                out[i:j] = np.maximum(0, _fritsch_carlson(t[near].astype(float), x[near], t[i:j].astype(float)))
        i = j
    return out


def _fritsch_carlson(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    h, d = np.diff(t), np.diff(y) / np.diff(t)
    m = np.concatenate([[d[0]], (d[1:] + d[:-1]) / 2, [d[-1]]])
    m[1:-1][d[1:] * d[:-1] <= 0] = 0
    for k in range(len(d)):
        if d[k] == 0:
            m[k] = m[k + 1] = 0
        else:
            a, b = m[k] / d[k], m[k + 1] / d[k]
            if a * a + b * b > 9:
                s = 3 / sqrt(a * a + b * b)
                m[k], m[k + 1] = s * a * d[k], s * b * d[k]
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(h) - 1)
    u = (at - t[k]) / h[k]
    return (2 * u**3 - 3 * u**2 + 1) * y[k] + (u**3 - 2 * u**2 + u) * h[k] * m[k] + (-2 * u**3 + 3 * u**2) * y[k + 1] + (u**3 - u**2) * h[k] * m[k + 1]


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float:
    i, j = np.triu_indices(len(x), 1)
    return float((np.sign(x[j] - x[i]) * np.sign(y[j] - y[i])).mean()) if len(i) else np.nan


def archimedean_parameter(family: str, tau: float) -> float:
    """The parameter of a one-parameter copula at Kendall's tau."""
    if family == "clayton":
        return 2 * tau / (1 - tau)
    if family == "gumbel":
        return 1 / (1 - tau)
    if family == "gaussian":
        return float(np.sin(pi * tau / 2))
    lo, hi = (1e-6, 100.0) if family == "frank" else (1.0 + 1e-9, 60.0)
    grid = (np.arange(2000) + 0.5) / 2000

    def tau_of(p: float) -> float:
        if family == "frank":
            s = grid * p
            return 1 - 4 / p * (1 - (s / np.expm1(s)).mean())
        g = 1 - (1 - grid) ** p
        return 1 + 4 * (np.log(np.maximum(g, 1e-300)) * g / (p * np.maximum((1 - grid) ** (p - 1), 1e-300))).mean()

    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tau_of(mid) < tau else (lo, mid)
    return (lo + hi) / 2


def copula_log_density(family: str, p: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    if family == "clayton":
        return np.log1p(p) - (1 + p) * np.log(u * v) - (2 + 1 / p) * np.log(u**-p + v**-p - 1)
    if family == "gumbel":
        a, b = (-np.log(u)) ** p, (-np.log(v)) ** p
        s = (a + b) ** (1 / p)
        return -s + (p - 1) * np.log(np.log(u) * np.log(v)) - np.log(u * v) + (1 / p - 2) * np.log(a + b) + np.log(s + p - 1)
    if family == "frank":
        e = np.expm1(-p)
        return np.log(-p * e) - p * (u + v) - 2 * np.log(np.abs(e + np.expm1(-p * u) * np.expm1(-p * v)))
    if family == "joe":
        a, b = (1 - u) ** p, (1 - v) ** p
        s = a + b - a * b
        return (1 / p - 2) * np.log(s) + np.log(p - 1 + s) + (p - 1) * np.log((1 - u) * (1 - v))
    x, y = norm_quantile(u), norm_quantile(v)
    return -0.5 * np.log(1 - p * p) - (p * p * (x * x + y * y) - 2 * p * x * y) / (2 * (1 - p * p))


def fit_copula(u: np.ndarray, v: np.ndarray) -> tuple[str, float, float, float]:
    """Family, parameter, AIC and tau; each family's parameter comes from tau, and the smallest AIC wins."""
    tau = kendall_tau(u, v)
    best = None
    for family in ("gaussian", "clayton", "gumbel", "frank", "joe"):
        if family != "gaussian" and not 0.01 < tau < 0.95:
            continue
        p = archimedean_parameter(family, tau)
        with np.errstate(all="ignore"):
            aic = 2 - 2 * float(np.sum(copula_log_density(family, p, u, v)))
        if np.isfinite(aic) and (best is None or aic < best[2]):
            best = (family, float(p), aic, tau)
    return best or ("independence", 0.0, 0.0, tau)


def kendall_cdf(family: str, p: float, t: np.ndarray) -> np.ndarray:
    """K(t) = t - phi(t) / phi'(t), with the generator's negative derivative."""
    t = np.asarray(t, float)
    if family == "clayton":
        return t + (t - t ** (p + 1)) / p
    if family == "gumbel":
        return t - t * np.log(t) / p
    if family == "frank":
        phi = -np.log(np.expm1(-p * t) / np.expm1(-p))
        return t - phi / (p * np.exp(-p * t) / np.expm1(-p * t))
    if family == "joe":
        g = 1 - (1 - t) ** p
        return t - np.log(g) * g / (p * (1 - t) ** (p - 1))
    return t - t * np.log(t)


def principal_components(x: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores [t, k], patterns [site, k] and shares of variance of standardised columns; signs make patterns' sums positive."""
    z = (x - x.mean(0)) / np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1)
    u, s, vt = np.linalg.svd(z * np.sqrt(weights), full_matrices=False)
    sign = np.where(vt[:k].sum(1) < 0, -1.0, 1.0)
    return u[:, :k] * s[:k] * sign, (vt[:k] * sign[:, None]).T, (s**2 / (s**2).sum())[:k]


def newey_west(x: np.ndarray, y: np.ndarray, lags: int | None = None) -> tuple[float, float]:
    """Slope of a line and its standard error under autocorrelation (Bartlett weights)."""
    n = len(x)
    lags = int(4 * (n / 100) ** (2 / 9)) if lags is None else lags
    a = np.stack([np.ones(n), x], 1)
    inv = np.linalg.inv(a.T @ a)
    b = inv @ a.T @ y
    g = a * (y - a @ b)[:, None]
    s = g.T @ g
    for k in range(1, lags + 1):
        c = g[k:].T @ g[:-k]
        s += (1 - k / (lags + 1)) * (c + c.T)
    return float(b[1]), float(sqrt(max(0.0, (inv @ s @ inv)[1, 1])))


def block_bootstrap_mean(x: np.ndarray, draws: int = 1000, block: int = 6, seed: int = 1) -> tuple[float, float]:
    """A 95 % interval of the mean by moving blocks."""
    r = np.random.Generator(np.random.PCG64(seed))
    n = len(x)
    block = min(block, n)
    k = -(-n // block)
    start = r.integers(0, n - block + 1, (draws, k))
    at = (start[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :n]
    lo, hi = np.percentile(x[at].mean(1), [2.5, 97.5])
    return float(lo), float(hi)


def _weibull_shape(logs: np.ndarray) -> float:
    """The likeliest Weibull shape of a sample, from its logarithms, by bisection."""
    mean, top = logs.mean(), logs.max()
    low, high = 1e-3, 1e3
    for _ in range(100):
        k = sqrt(low * high)
        w = np.exp(k * (logs - top))
        low, high = (k, high) if (w * logs).sum() / w.sum() - 1 / k < mean else (low, k)
    return sqrt(low * high)


def best_margin(x: np.ndarray) -> tuple[str, tuple[float, float], float]:
    """Family, parameters and AIC of the best margin; positive families only for positive samples, beta within (0, 1)."""
    n, m, s = len(x), x.mean(), x.std()
    found = [("norm", (m, s), -n * log(s * sqrt(2 * pi)) - ((x - m) ** 2).sum() / (2 * s * s), 2)]
    sc = s * sqrt(3) / pi
    y = (x - m) / sc
    found.append(("logis", (m, sc), float((-y - log(sc) - 2 * np.log1p(np.exp(-y))).sum()), 2))
    if (x > 0).all():
        found.append(("exp", (1 / m, np.nan), -n * log(m) - n, 1))
        a, b = fit_gamma(*l_moments(x)[:2])
        found.append(("gamma", (a, b), float(((a - 1) * np.log(x) - x / b).sum() - n * (lgamma(a) + a * log(b))), 2))
        v = np.log(x)
        found.append(("lnorm", (v.mean(), v.std()), float(-v.sum() - n * log(v.std() * sqrt(2 * pi)) - n / 2), 2))
        k = _weibull_shape(v)
        scale = float(np.mean(x**k) ** (1 / k))
        found.append(("weibull", (k, scale), float(n * log(k) - n * k * log(scale) + (k - 1) * v.sum() - ((x / scale) ** k).sum()), 2))
        if (x < 1).all() and s * s < m * (1 - m):
            c = m * (1 - m) / (s * s) - 1
            a, b = m * c, (1 - m) * c
            ll = (a - 1) * v.sum() + (b - 1) * np.log1p(-x).sum() + n * (lgamma(a + b) - lgamma(a) - lgamma(b))
            found.append(("beta", (a, b), float(ll), 2))
    scored = [(2 * k - 2 * ll, f, p) for f, p, ll, k in found if np.isfinite(ll)]
    aic, f, p = min(scored, key=lambda z: z[0])
    return f, (float(p[0]), float(p[1])), float(aic)


def poisson_interval(count: int, years: float, level: float = 0.95) -> tuple[float, float]:
    """Bounds of a return period from the count of events in so many years."""
    low = chi2_quantile((1 - level) / 2, 2 * count) / 2 if count else 0.0
    high = chi2_quantile((1 + level) / 2, 2 * count + 2) / 2
    return years / high, years / low if low else np.inf
