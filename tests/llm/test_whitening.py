"""Whitening against numpy and Python's integers."""

import numpy as np
import pytest

from xeric.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, whitened string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, "w") for i, v in vectors], SCHEMA)


def plain(vectors, k):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    d = (x * n - s)
    c = (d / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return (d**2).sum(1), c @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("scale", [0.3, 3e6, 3e11])
def test_equal_to_numpy(spark, scale):
    """Also where a long cannot hold the products, or not the deviation."""
    r = np.random.default_rng(5)
    vectors = (r.normal(size=(300, 12)) @ np.diag(np.linspace(1, 3, 12)) * scale).tolist()
    odd = [(1000, None), (1001, [1.0, None] * 6), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), (1004, []), (1005, [1.0, 2.0])]
    got = whitening.by_component(whitening.whiten(table(spark, [*enumerate(vectors), *odd]).repartition(3)), "vec_id").collect()
    deviation, w, share = plain(vectors, 8)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by) == 300 * 8
    sign = [1 if by[0, k + 1]["whitened"] * w[0, k] > 0 else -1 for k in range(8)]
    for i in range(300):
        for k in range(8):
            r = by[i, k + 1]
            assert r["n"] == 300 and abs(r["whitened"] * sign[k] - w[i, k]) < 1e-6 and abs(r["explained"] / share[k] - 1) < 1e-9
            assert r["deviation"] == (int(deviation[i]) if deviation[i] < 2**63 else None)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_odd_tables(spark):
    assert whitening.by_component(whitening.whiten(table(spark, [])), "vec_id").count() == 0
    assert whitening.whiten(table(spark, [(1, None)])).columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.by_component(whitening.whiten(table(spark, [(1, [0.5, 1.0]), (1, [0.5, 1.0])])), "vec_id").collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 2, 0, None, None, None), (2, 2, 0, None, None, None)] * 2
    flat = whitening.by_component(whitening.whiten(table(spark, [(i, [float(i), 7.0]) for i in range(4)])), "vec_id").collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True} and flat[0]["identity_error"] < 1e-9
