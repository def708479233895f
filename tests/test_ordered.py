"""Whole-table order without one task: false discovery rates and quantiles against plain versions."""

import math
import random

import numpy as np
import pytest

from xeric.operators import ordered
from xeric.operators.ordered import exact_quantiles, false_discovery
from xeric.sources.scratch import join_split, written


def plain_bh(rows):
    """{row number: adjusted p} of (group, p) rows."""
    out = {}
    for g in {r[0] for r in rows}:
        mine = sorted((p, i) for i, (k, p) in enumerate(rows) if k == g and p is not None and not math.isnan(p))
        low = 1.0
        for rank in range(len(mine), 0, -1):
            p, i = mine[rank - 1]
            low = min(low, p * len(mine) / rank)
            out[i] = low
    return out


def rows_with_ties(n=3000, seed=4):
    r = random.Random(seed)
    p = lambda: r.choice([0.04, 0.04, 0.5, r.random() ** 3, round(r.random(), 2), None, float("nan")])
    return [(r.choice(["a", "a", "b", None]), p()) for _ in range(n)]


@pytest.mark.parametrize("grouped", [True, False])
def test_false_discovery(spark, grouped):
    rows = rows_with_ties()
    df = written(spark.createDataFrame([(i, g, p, "x") for i, (g, p) in enumerate(rows)], "i int, g string, p double, c string"), "rows")
    out = false_discovery(df, ["g"] if grouped else [])
    assert out.columns == ["i", "g", "p", "c", "p_adjusted"]
    want = plain_bh(rows if grouped else [("all", p) for _, p in rows])
    got = {r["i"]: r["p_adjusted"] for r in out.collect()}
    assert len(got) == len(rows) and all((got[i] is None) == (i not in want) for i in got)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_no_task_holds_all(spark):
    df = written(spark.range(5000).select((F_id() % 997 / 997).alias("p")), "p")
    for out in (false_discovery(df, []), ordered.ordered_counts(df, [], "p")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan


def F_id():
    from pyspark.sql import functions as F

    return F.col("id")


def test_false_discovery_of_nothing(spark):
    empty = spark.createDataFrame([], "i int, p double")
    assert false_discovery(empty, []).count() == 0
    nulls = false_discovery(spark.createDataFrame([(1, None), (2, float("nan"))], "i int, p double"), [])
    assert sorted((r["i"], r["p_adjusted"]) for r in nulls.collect()) == [(1, None), (2, None)]


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one"])
def test_quantiles(spark, monkeypatch, kind):
    """With ranges narrowed many times: a pass may collect three values only and reads eight places."""
    monkeypatch.setattr(ordered, "MOST_VALUES", 3)
    monkeypatch.setattr(ordered, "PLACES", 8)
    r = np.random.default_rng(7)
    v = {"normal": r.normal(size=2500), "ties": r.choice([1.0, 1.0, 1.0, 1.0, 2.0, 3.5], 2000), "wide": 10.0 ** r.uniform(-300, 300, 1500), "one": np.full(40, 7.0)}[kind]
    rows = [(float(x),) for x in v] + [(None,), (float("nan"),), (float("inf"),)]
    probs = [0.0, 0.1, 0.5, 0.77, 0.999, 1.0]
    got = exact_quantiles(spark.createDataFrame(rows, "v double").repartition(4), "v", probs).collect()
    assert got[0]["n"] == len(v) and np.allclose(got[0]["quantiles"], np.quantile(v, probs), rtol=1e-12, atol=0)


@pytest.mark.parametrize("most", [1000, 2])
def test_grouped_quantiles(spark, monkeypatch, most):
    """Also beyond the number of groups whose ranges the driver holds."""
    monkeypatch.setattr(ordered, "MOST_GROUPS", most)
    monkeypatch.setattr(ordered, "MOST_VALUES", 5)
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "c", None]), r.choice([r.random(), 0.5])) for _ in range(900)] + [("empty", None)]
    got = {x["g"]: x["quantiles"] for x in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0.25, 0.9], ["g"]).collect()}
    want = {g: np.quantile([v for k, v in rows if k == g], [0.25, 0.9]) for g in ("a", "b", "c", None)}
    assert set(got) == set(want) and all(np.allclose(got[g], want[g]) for g in want)
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0


def test_split_join(spark, monkeypatch):
    from xeric.sources import scratch

    monkeypatch.setattr(scratch, "MOST_BROADCAST", 0)
    left = spark.createDataFrame([(i, None if i % 50 == 0 else 0 if i % 3 else i) for i in range(3000)], "i int, k int")
    right = spark.createDataFrame([(0, "hot"), (0, "twin"), (3, "three")], "k int, v string")
    for how in ("inner", "left"):
        got = sorted(map(str, join_split(left, right, ["k"], how).select("i", "k", "v").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("i", "k", "v").collect()))
