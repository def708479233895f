"""Additive models against a dense fit in numpy and a known surface."""

import numpy as np
import pytest

from xeric.operators import additive as A


def plain_basis(x, low, high, k, cyclic=False):
    """B-splines by the recursion on knots."""
    x = np.asarray(x, float)
    if cyclic:
        step = (high - low) / k
        knots = low + step * np.arange(-8, 2 * k + 8)
    else:
        step = ((high - low) or 1.0) / (k - 3)
        knots = low + step * np.arange(-3, k + 1)
        x = np.clip(x, low, high)
    b = [(knots[i] <= x) & (x < knots[i + 1]) for i in range(len(knots) - 1)]
    b = [v.astype(float) for v in b]
    for d in (1, 2, 3):
        b = [(x - knots[i]) / (d * step) * b[i] + (knots[i + d + 1] - x) / (d * step) * b[i + 1] for i in range(len(b) - 1)]
    b = np.array(b).T
    if not cyclic:
        return b[:, :k]
    out = np.zeros((len(x), k))
    for i in range(b.shape[1]):
        out[:, (i - 4) % k] += b[:, i]  # knot i starts the function whose first place is i - 8, four before its number
    return out


@pytest.fixture(scope="module")
def surface(spark):
    r = np.random.default_rng(8)
    n = 4000
    a, b, m = r.uniform(-2, 3, n), r.uniform(0, 10, n), r.integers(1, 13, n)
    truth = np.sin(a) + 0.3 * (a - 0.5) * (b - 5) / 5 + np.cos(2 * np.pi * m / 12)
    y = 7 + truth + r.normal(0, 0.2, n)
    rows = [tuple(map(float, t)) for t in zip(y, a, b, m, strict=True)]
    extra = [(None, 1.0, 1.0, 1.0), (1.0, None, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0), (1.0, float("inf"), 1.0, 2.0)]
    return spark.createDataFrame(rows + extra, "y double, a double, b double, m double").repartition(5), (y, a, b, m, truth)


@pytest.fixture(scope="module")
def fitted(surface):
    return A.fit_additive(surface[0], "y", ["a", "b"], [("a", "b")], {"m": (1.0, 13.0)})


def test_known_surface_comes_back(surface, fitted):
    d, (y, a, b, m, truth) = surface
    assert fitted.n == 4000 and abs(fitted.explained - np.var(truth) / np.var(y)) < 0.02
    got = np.array([r["predicted"] for r in A.predict_terms(d, fitted).filter("y is not null and not isnan(y) and a < 9").collect()])
    order = [r for r in d.filter("y is not null and not isnan(y) and a < 9").collect()]
    want = np.array([7 + np.sin(r["a"]) + 0.3 * (r["a"] - 0.5) * (r["b"] - 5) / 5 + np.cos(2 * np.pi * r["m"] / 12) for r in order])
    assert np.sqrt(np.mean((got - want) ** 2)) < 0.05


def test_coefficients_equal_a_dense_fit(surface, fitted):
    _, (y, a, b, m, _) = surface
    blocks = []
    for basis in fitted.bases:
        x = {"a": a, "b": b, "m": m}[basis.variable]
        full = plain_basis(x, basis.low, basis.high, basis.size, basis.cyclic)
        assert np.allclose(full.sum(axis=1)[x < basis.high], 1)
        if not basis.cyclic:
            full[x >= basis.high] = plain_basis([basis.high - 1e-12], basis.low, basis.high, basis.size)
        blocks.append((full - full.mean(axis=0))[:, :-1])
    x = np.ones((len(y), len(fitted.coefficients)))
    penalty = np.zeros((x.shape[1], x.shape[1]))
    for t in fitted.terms:
        at = slice(t.start, t.stop)
        one = blocks[t.bases[0]]
        x[:, at] = one if len(t.bases) == 1 else np.array([np.outer(p, q).ravel() for p, q in zip(one, blocks[t.bases[1]], strict=True)])
        parts = []
        for i in t.bases:
            k, ring = fitted.bases[i].size, fitted.bases[i].cyclic
            s = np.zeros((k, k))
            for j in range(k if ring else k - 2):
                e = np.zeros(k)
                for place, v in zip((j, j + 1, j + 2), (1, -2, 1), strict=True):
                    e[place % k] += v
                s += np.outer(e, e)
            parts.append(s[:-1, :-1])
        s = parts[0] if len(parts) == 1 else np.kron(parts[0], np.eye(len(parts[1]))) + np.kron(np.eye(len(parts[0])), parts[1])
        s = s / np.trace(s) + A.SHRINKAGE * np.eye(len(s)) / len(s)
        penalty[at, at] = s * np.sum(x[:, at] ** 2) * fitted.penalties[fitted.terms.index(t)]
    root = np.linalg.cholesky(penalty + 1e-14 * np.eye(len(penalty))).T  # least squares on rows put below, not normal equations
    want = np.linalg.lstsq(np.vstack([x, root]), np.concatenate([y - y.mean(), np.zeros(len(root))]), rcond=None)[0]
    want[0] += y.mean()
    assert np.allclose(fitted.coefficients, want, atol=1e-6)


def test_shares_and_table(surface, fitted, spark):
    shares = {r["term"]: r for r in A.variance_shares(surface[0], fitted).collect()}
    assert abs(sum(r["share"] for r in shares.values()) - 1) < 1e-9
    assert shares["s(m)"]["share"] > shares["ti(a,b)"]["share"] > shares["s(b)"]["share"]
    assert shares["s(b)"]["edf"] < 3
    assert fitted.table(spark).count() == len(fitted.coefficients) == 1 + 7 + 7 + 5 + 25


def test_odd_tables(spark):
    d = spark.createDataFrame([(1.0, 2.0, 2.0)] * 5 + [(2.0, 2.0, 2.0)], "y double, a double, b double")
    fit = A.fit_additive(d, "y", ["a", "b"], [("a", "b")])
    got = A.predict_terms(d.withColumn("predicted", d.y), fit).collect()
    assert np.allclose([r["predicted"] for r in got], 7 / 6) and fit.n == 6
    assert A.fit_additive(d.limit(0), "y", ["a"]) is None
    far = spark.createDataFrame([(None,), (float("nan"),), (1e9,)], "a double").selectExpr("a", "a AS b")
    assert [r["predicted"] is None or r["predicted"] != r["predicted"] for r in A.predict_terms(far, fit).collect()] == [True, True, False]
    with pytest.raises(ValueError, match="coefficients"):
        A.fit_additive(d, "y", ["a", "b"], [("a", "b")], k_pair=60)
