"""Numeric kernels of fits that move: seven copula families, changing dependence, changing gamma margins, bootstraps.

Each sees one bounded record. All draws are seeded, so reruns agree.
"""

from __future__ import annotations

from math import erfc, lgamma, log, pi, sqrt

import numpy as np

from . import kernels as K
from . import risk_kernels as R

FAMILIES = ("frank", "gumbel", "plackett", "survival_clayton", "joe", "gaussian", "student")
MOVING = ("clayton", "gumbel", "frank", "gaussian", "joe")
_log_gamma = np.frompyfunc(lgamma, 1, 1)


def minimise(f, start: np.ndarray, steps: int = 400, width: float = 0.5) -> tuple[np.ndarray, float]:
    """Nelder and Mead's simplex from one start; for a few parameters. Values that aren't finite count as infinite."""

    def at(x):
        with np.errstate(all="ignore"):
            v = float(f(x))
        return v if np.isfinite(v) else np.inf

    start = np.asarray(start, float)
    points = [start, *(start + width * e for e in np.eye(len(start)))]
    values = [at(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if np.max(np.abs(np.array(points[1:]) - points[0])) < 1e-8:
            break
        centre = np.mean(points[:-1], axis=0)
        far = centre + (centre - points[-1])
        v = at(far)
        if v < values[0]:
            further = centre + 2 * (centre - points[-1])
            w = at(further)
            points[-1], values[-1] = (further, w) if w < v else (far, v)
        elif v < values[-2]:
            points[-1], values[-1] = far, v
        else:
            near = centre + 0.5 * ((far if v < values[-1] else points[-1]) - centre)
            w = at(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                values = [values[0], *(at(p) for p in points[1:])]
    i = int(np.argmin(values))
    return points[i], values[i]


def t4_quantile(p: np.ndarray) -> np.ndarray:
    """Quantiles of Student's t with 4 degrees of freedom, in closed form."""
    a = np.sqrt(4 * p * (1 - p))
    return np.sign(p - 0.5) * 2 * np.sqrt(np.maximum(np.cos(np.arccos(np.minimum(a, 1.0)) / 3) / a - 1, 0.0))


def t5_cdf(x: np.ndarray) -> np.ndarray:
    """Distribution of Student's t with 5 degrees of freedom, in closed form."""
    a = np.arctan(x / sqrt(5))
    c = np.cos(a)
    return 0.5 + (a + np.sin(a) * c * (1 + 2 / 3 * c * c)) / pi


def log_density(family: str, p, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Log density of one of the seven families (Student's t has 4 degrees of freedom) or of the kernels' own."""
    if family == "survival_clayton":
        return K.copula_log_density("clayton", p, 1 - u, 1 - v)
    if family == "plackett":
        e = p - 1
        s = 1 + e * (u + v)
        return np.log(p) + np.log(1 + e * (u + v - 2 * u * v)) - 1.5 * np.log(s * s - 4 * p * e * u * v)
    if family == "student":
        x, y = t4_quantile(u), t4_quantile(v)
        joint = -3 * np.log1p((x * x - 2 * p * x * y + y * y) / (4 * (1 - p * p))) - np.log(2 * pi) - 0.5 * np.log(1 - p * p)
        return joint - 2 * log(0.375) + 2.5 * (np.log1p(x * x / 4) + np.log1p(y * y / 4))
    return K.copula_log_density(family, p, u, v)


def conditional(family: str, p: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """P(U <= u | V = v), value by value."""
    u, v = np.clip(u, 1e-9, 1 - 1e-9), np.clip(v, 1e-9, 1 - 1e-9)
    if family == "survival_clayton":
        return 1 - R.conditional_level("clayton", p, 1 - u, 1 - v)
    if family == "plackett":
        e = p - 1
        if abs(e) < 1e-9:
            return u
        s = 1 + e * (u + v)
        return 0.5 * (1 - (s - 2 * p * u) / np.sqrt(s * s - 4 * p * e * u * v))
    if family == "student":
        x, y = t4_quantile(u), t4_quantile(v)
        return t5_cdf((x - p * y) / np.sqrt((4 + y * y) * (1 - p * p) / 5))
    if family == "gaussian":
        return R.normal_cdf((K.norm_quantile(u) - p * K.norm_quantile(v)) / sqrt(1 - p * p))
    return R.conditional_level(family, p, u, v)


def sample(family: str, p: float, n: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """n pairs: v uniform, u by bisection of the conditional distribution."""
    v, target = r.random(n), r.random(n)
    low, high = np.full(n, 1e-9), np.full(n, 1 - 1e-9)
    for _ in range(45):
        mid = (low + high) / 2
        under = conditional(family, p, mid, v) < target
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2, v


def parameter(family: str, u: np.ndarray, v: np.ndarray, tau: float) -> float | None:
    """A family's parameter from tau, Plackett's by likelihood; None where the family can't have this tau."""
    if family in ("gaussian", "student"):
        return float(np.sin(pi * np.clip(tau, -0.99, 0.99) / 2))
    if family == "plackett":
        x, _ = minimise(lambda a: -log_density(family, float(np.exp(a[0])), u, v).sum(), np.array([3 * tau]))
        return float(np.exp(np.clip(x[0], -12, 12)))
    if not 0.01 < tau < 0.95:
        return None
    return float(K.archimedean_parameter("clayton" if family == "survival_clayton" else family, tau))


def choose_copula(u: np.ndarray, v: np.ndarray, upper_tail: float = np.nan, ties_ok: bool = True, slack: float = 4.0) -> tuple[str, float, float, float]:
    """Family, parameter, AIC and tau of the best of seven families.

    Joe or Gumbel is taken instead of the smallest AIC if it is within ``slack`` of it, the upper tail coefficient is
    above 0.5 and ties don't blur the tail.
    """
    tau = K.kendall_tau(u, v)
    found = {}
    for family in FAMILIES:
        p = parameter(family, u, v, tau)
        if p is not None:
            with np.errstate(all="ignore"):
                aic = 2 - 2 * float(np.sum(log_density(family, p, u, v)))
            if np.isfinite(aic):
                found[family] = (aic, p)
    if not found:
        return "independence", 0.0, 0.0, tau
    best = min(found, key=lambda f: found[f][0])
    if upper_tail > 0.5 and ties_ok:
        near = [f for f in ("joe", "gumbel") if f in found and found[f][0] - found[best][0] <= slack]
        best = min(near, key=lambda f: found[f][0]) if near else best
    return best, found[best][1], found[best][0], tau


def upper_tail(u: np.ndarray, v: np.ndarray) -> float:
    """Upper tail coefficient by Caperaa, Fougeres and Genest."""
    m = np.log(np.sqrt(np.log(1 / u) * np.log(1 / v)) / np.log(1 / np.maximum(u, v) ** 2))
    return float(2 - 2 * np.exp(m.mean()))


def tail_ties_ok(v: np.ndarray, q: float = 0.9, tolerance: float = 0.5) -> bool:
    """Whether the share above the quantile lies within ``tolerance`` of its nominal share, relatively."""
    return abs((v > q).mean() - (1 - q)) <= tolerance * (1 - q)


def rosenblatt_distance(family: str, p: float, u: np.ndarray, v: np.ndarray) -> float:
    """Cramer and von Mises's distance of (C(u | v), v) from independent uniforms."""
    e = u if family == "independence" else conditional(family, p, u, v)
    joint = ((e[:, None] >= e) & (v[:, None] >= v)).mean(1)
    return float(((joint - e * v) ** 2).sum())


def goodness_of_fit(u: np.ndarray, v: np.ndarray, draws: int = 499, seed: int = 11) -> tuple[str, float, float, float]:
    """Family, parameter, distance and the p of a parametric bootstrap that refits each draw."""
    family, p, _, _ = choose_copula(u, v, upper_tail(u, v), tail_ties_ok(v))
    seen = rosenblatt_distance(family, p, u, v)
    r = np.random.Generator(np.random.PCG64(seed))
    n, beyond = len(u), 0
    for _ in range(draws):
        a, b = (r.random(n), r.random(n)) if family == "independence" else sample(family, p, n, r)
        a, b = (K.average_ranks(x) / (n + 1) for x in (a, b))
        q = 0.0 if family == "independence" else parameter(family, a, b, K.kendall_tau(a, b))
        beyond += q is not None and rosenblatt_distance(family, q, a, b) >= seen
    return family, p, seen, (beyond + 0.5) / (draws + 1)


def family_stability(u: np.ndarray, raw: np.ndarray, seeds: int = 30, agree: float = 0.9) -> tuple[str, float, float, bool]:
    """The family chosen most over seeds that spread ties at the largest raw value, its share, its parameter's CV, and
    whether at least ``agree`` of the seeds chose it with a CV of at most 0.1."""
    n = len(raw)
    top = raw >= raw.max() - 1e-6
    if top.sum() < 2:
        top = np.zeros(n, bool)
    share = top.mean()
    inner = np.zeros(n)
    if (~top).any():
        inner[~top] = (1 - share) * K.average_ranks(raw[~top]) / ((~top).sum() + 1)
    got = []
    for seed in range(seeds):
        jitter = np.random.Generator(np.random.PCG64(seed)).random(n)
        v = np.clip(np.where(top, 1 - share + share * jitter, inner), 1e-6, 1 - 1e-6)
        got.append(choose_copula(u, v, upper_tail(u, v), tail_ties_ok(v))[:2])
    names = [f for f, _ in got]
    best = max(sorted(set(names)), key=names.count)
    p = np.array([x for f, x in got if f == best])
    cv = float(p.std() / abs(p.mean())) if p.mean() else 0.0
    part = names.count(best) / seeds
    return best, part, cv, part >= agree and cv <= 0.1


def _link(family: str, a: np.ndarray) -> np.ndarray:
    a = np.clip(a, -8.0, 8.0)
    if family == "gaussian":
        return np.tanh(a) * 0.999
    if family == "frank":
        return np.where(np.abs(4 * a) < 1e-4, 1e-4, 4 * a)
    return np.exp(a) if family == "clayton" else 1.0001 + np.exp(a)


def moving_copula(u: np.ndarray, v: np.ndarray, years: np.ndarray, split: float | None = None) -> tuple:
    """Best family of a copula whose parameter is constant, a line in the year on its link scale, or split in two.

    Gives (family, model by BIC, slope, p of the line against the constant by a chi-square of one degree, the three
    BICs). The split is at the median year unless given.
    """
    t = (years - years.mean()) / (years.std(ddof=1) or 1.0)
    late = years > (np.median(years) if split is None else split)
    best = None
    for family in MOVING:
        loss = lambda a: -float(np.sum(K.copula_log_density(family, _link(family, a), u, v)))  # noqa: B023, E731
        a0, constant = minimise(lambda x: loss(np.full(len(u), x[0])), np.array([0.0]))  # noqa: B023
        if not np.isfinite(constant):
            continue
        a1, line = minimise(lambda x: loss(x[0] + x[1] * t), np.array([a0[0], 0.0]))  # noqa: B023
        line = min(line, constant)
        _, parts = minimise(lambda x: loss(np.where(late, x[1], x[0])), np.array([a0[0], a0[0]]))  # noqa: B023
        bic = [2 * x + k * log(len(u)) for x, k in ((constant, 1), (line, 2), (min(parts, constant), 2))]
        if best is None or min(bic) < min(best[4:]):
            model = ("constant", "line", "split")[int(np.argmin(bic))]
            best = (family, model, float(a1[1]), erfc(sqrt(max(0.0, constant - line))), *bic)
    return best or ("independence", "constant", 0.0, 1.0, 0.0, 0.0, 0.0)


def moving_gamma(x: np.ndarray, years: np.ndarray, share_early: float = 0.4, share_late: float = 0.3) -> tuple:
    """Gamma margin of positive values: constant, mean moving with the year, or mean and spread moving (log links).

    Gives (model of smallest AIC, p of the moving mean against the constant, mean and coefficient of variation in the
    middle of the early and of the late years, the three AICs).
    """
    t = (years - years.mean()) / (years.std(ddof=1) or 1.0)
    first, span = years.min(), years.max() - years.min()

    def loss(mean, sigma):
        shape = 1 / np.clip(sigma, 1e-3, 1e3) ** 2
        scale = mean / shape
        return -float(np.sum((shape - 1) * np.log(x) - x / scale - shape * np.log(scale) - _log_gamma(shape).astype(float)))

    def parts(a, k):
        slope, turn = (a[2] if k > 2 else 0.0), (a[3] if k > 3 else 0.0)
        return np.exp(a[0] + slope * t), np.exp(a[1] + turn * t)

    start = np.array([log(x.mean()), log(max(x.std() / x.mean(), 1e-2))])
    fits = []
    for k in (2, 3, 4):
        a, value = minimise(lambda z, k=k: loss(*parts(z, k)), np.append(start, np.zeros(k - len(start))), 800)
        a2, value2 = minimise(lambda z, k=k: loss(*parts(z, k)), a, 800, 0.05)
        start = a2 if value2 <= value else a
        fits.append((start, min(value, value2)))
    aic = [2 * v + 2 * len(a) for a, v in fits]
    best = int(np.argmin(aic))
    a = np.append(fits[best][0], np.zeros(2 - best))
    middle = [(y - years.mean()) / (years.std(ddof=1) or 1.0) for y in (first + span * share_early / 2, first + span * (1 - share_late / 2))]
    mean, spread = ([float(np.exp(a[i] + a[i + 2] * m)) for m in middle] for i in (0, 1))
    p = erfc(sqrt(max(0.0, fits[0][1] - fits[1][1])))
    return ("constant", "mean", "mean_spread")[best], p, mean[0], mean[1], spread[0], spread[1], *aic


def block_bootstrap_p(event: np.ndarray, x: np.ndarray, draws: int = 5000, block: int = 6, seed: int = 1) -> tuple[float, float, float, float]:
    """Mean of event months less that of the others, its 95 % interval by moving blocks, and the p of no difference."""
    r = np.random.Generator(np.random.PCG64(seed))
    n = len(x)
    block = min(block, n)
    need = -(-n // block)
    seen = float(x[event].mean() - x[~event].mean())
    got = []
    for first in range(0, draws, 500):
        start = r.integers(0, n - block + 1, (min(500, draws - first), need))
        at = (start[:, :, None] + np.arange(block)).reshape(len(start), -1)[:, :n]
        e, v = event[at], x[at]
        inside, outside = e.sum(1), (~e).sum(1)
        ok = (inside > 0) & (outside > 0)
        with np.errstate(all="ignore"):
            got.append(((v * e).sum(1) / inside - (v * ~e).sum(1) / outside)[ok])
    d = np.concatenate(got)
    if not len(d):
        return seen, np.nan, np.nan, np.nan
    low, high = np.percentile(d, [2.5, 97.5])
    under = ((d <= 0).sum() + 1) / (len(d) + 1)
    over = ((d >= 0).sum() + 1) / (len(d) + 1)
    return seen, float(low), float(high), float(min(1.0, 2 * min(under, over)))


def mean_shift_interval(late: np.ndarray, base: float, draws: int = 2000, seed: int = 42) -> tuple[float, float]:
    """95 % interval of mean(late) - base by resampling the late values."""
    r = np.random.Generator(np.random.PCG64(seed))
    d = late[r.integers(0, len(late), (draws, len(late)))].mean(1) - base
    low, high = np.percentile(d, [2.5, 97.5])
    return float(low), float(high)


def gamma_or_places(x: np.ndarray, least: int = 4) -> tuple[np.ndarray, str | None]:
    """Normal scores of a component's values: gamma by L-moments with a mass at zero, else places rank / (n + 1).

    The probability is held to 0.0001..0.9999; under two different values it is 0.5.
    """
    ok = np.isfinite(x)
    v = x[ok]
    z = np.full(len(x), np.nan)
    if not len(v):
        return z, None
    p, method = K.average_ranks(v) / (len(v) + 1), "places"
    wet = v[v > 0]
    if len(np.unique(v)) < 2:
        p, method = np.full(len(v), 0.5), "constant"
    elif (v >= 0).all() and len(wet) >= least and wet.std() > 0:
        a, b = K.fit_gamma(*K.l_moments(wet)[:2])
        if np.isfinite(a) and np.isfinite(b) and a > 0 and b > 0:
            dry = 1 - len(wet) / len(v)
            p, method = dry + (1 - dry) * K.gamma_p(a, np.maximum(v, 0.0) / b), "gamma"
    z[ok] = K.norm_quantile(np.clip(p, 1e-4, 1 - 1e-4))
    return z, method


def johnson_neyman(x: np.ndarray, w: np.ndarray, y: np.ndarray, level: float = 1.959963984540054) -> tuple[float, float, float, float]:
    """Effect of x on y at w = 0, its change with w, and the values of w between or beyond which it becomes significant.

    The bounds are the roots of effect(w)^2 = level^2 var(effect(w)); nan where there are none.
    """
    a = np.stack([np.ones(len(x)), x, w, x * w], 1)
    b, _, rank, _ = np.linalg.lstsq(a, y, rcond=None)
    if rank < 4 or len(x) <= 4:
        return np.nan, np.nan, np.nan, np.nan
    rest = y - a @ b
    cov = np.linalg.inv(a.T @ a) * (rest @ rest) / (len(x) - 4)
    q = level * level
    c2, c1, c0 = b[3] ** 2 - q * cov[3, 3], 2 * (b[1] * b[3] - q * cov[1, 3]), b[1] ** 2 - q * cov[1, 1]
    d = c1 * c1 - 4 * c2 * c0
    if d < 0 or abs(c2) < 1e-15:
        return float(b[1]), float(b[3]), np.nan, np.nan
    roots = sorted(((-c1 - sqrt(d)) / (2 * c2), (-c1 + sqrt(d)) / (2 * c2)))
    return float(b[1]), float(b[3]), float(roots[0]), float(roots[1])
