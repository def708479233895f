"""Polygons, grids and nearest features against brute force."""

import random

import numpy as np
import pytest

from xeric.operators import grids, polygons
from xeric.operators.grids import Grid
from xeric.sources import scratch


def stars(r, n):
    """(key, ring, hole) rows of different sizes, with corners on whole numbers, and for some a hole."""
    out = []
    for k in range(n):
        size, cx, cy = r.choice([3, 20, 200]), r.randint(-50, 50), r.randint(-50, 50)
        ring = [(round(cx + size * f * np.cos(a)), round(cy + size * f * np.sin(a))) for a, f in zip(np.linspace(0, 2 * np.pi, 9)[:-1], [r.uniform(0.4, 1) for _ in range(8)], strict=True)]
        out.append((k, ring[:: r.choice([1, -1])], False))
        if k % 2:
            out.append((k, [(cx, cy), (cx + size // 4, cy), (cx, cy + size // 4)], True))
    return out


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return n % 2 == 1


SHAPES = "basin int, ring array<struct<x:double,y:double>>, hole boolean"


def frame(spark, rows):
    return spark.createDataFrame([(k, [(float(x), float(y)) for x, y in ring], h) for k, ring, h in rows], SHAPES)


@pytest.mark.parametrize("most", [200_000, 0])
def test_points_in_polygons(spark, monkeypatch, most):
    """Also on corners and edges, where places are whole numbers; and by joins that split hot cells."""
    monkeypatch.setattr(scratch, "MOST_BROADCAST", most)
    r = random.Random(3)
    shapes = stars(r, 12)
    at = [(i, r.randint(-80, 80) / r.choice([1, 1, 4]), r.randint(-80, 80) / r.choice([1, 1, 4])) for i in range(700)] + [(i, 1.0, 2.0) for i in range(700, 900)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in at] + [(900, None, 1.0)], "p int, x double, y double")
    got = sorted(tuple(x) for x in polygons.points_in_polygons(points, frame(spark, shapes), "p", "basin").collect())
    by = {k: [s[1] for s in shapes if s[0] == k] for k in range(12)}
    assert got == sorted((i, k) for i, x, y in at for k in by if inside(by[k], x, y))


def test_no_polygon(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "p int, x double, y double")
    flat = frame(spark, [(1, [(0, 0), (1, 1)], False), (2, [(3, 3), (3, 3), (3, 3)], False)])
    got = polygons.points_in_polygons(points, flat, "p", "basin")
    assert got.columns == ["p", "basin"] and got.count() == 0
    assert polygons.cell_cover(flat, "basin", 0, 0, 1, 1).count() == 0


def area(ring):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_cover(spark):
    """A polygon's cover sums to its area; half a cell is half, and a whole cell inside is 1."""
    box = [(0, [(0.5, 0.5), (3.5, 0.5), (3.5, 2.0), (0.5, 2.0)], False), (0, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)], True)]
    got = {(r["col"], r["row"]): r["cover"] for r in polygons.cell_cover(frame(spark, box), "basin", 0.0, 0.0, 1.0, 1.0).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {(0, 0): 0.25, (1, 0): 0.5, (2, 0): 0.5, (3, 0): 0.25, (0, 1): 0.5, (2, 1): 1.0, (3, 1): 0.5}
    r = random.Random(8)
    hulls = []  # convex, so that a ring does not cross itself
    for k in range(6):
        a = np.sort([r.uniform(0, 2 * np.pi) for _ in range(9)])
        hulls.append((k, [(7 * k + 30 * np.cos(t), -k + 20 * np.sin(t)) for t in a][:: 1 if k % 2 else -1], False))
    sums = {}
    for x in polygons.cell_cover(frame(spark, hulls), "basin", -3.3, 1.7, 2.5, 4.0).collect():
        assert -1e-9 <= x["cover"] <= 1 + 1e-9
        sums[x["basin"]] = sums.get(x["basin"], 0) + x["area"]
    assert all(abs(sums[k] - area(ring)) < 1e-6 for k, ring, _ in hulls)
    cells = spark.createDataFrame([(0, 0, 10.0), (9, 9, 10.0)], "col long, row long, area double")
    eff = polygons.effective_area(cells, polygons.cell_cover(frame(spark, box), "basin", 0.0, 0.0, 1.0, 1.0))
    assert {(r["col"], r["cover"], r["effective_area"]) for r in eff.collect()} == {(0, 0.25, 2.5), (9, 0.0, 0.0)}


def test_resampling(spark):
    source, target = Grid(10, 20, 1, 2, 4, 3), Grid(9.2, 19.5, 0.6, 0.9, 10, 9)
    rows = [(c, r, m, None if (c, r) == (1, 1) else c * 10.0 + r) for c in range(4) for r in range(3) for m in ("2000-01-01", "2000-02-01") if (c, r) != (2, 2)]
    df = spark.createDataFrame(rows, "col long, row long, month string, value double")
    got = {(x["col"], x["row"], x["month"]): x["value"] for x in grids.resample_nearest(df, source, target).collect()}
    want = {}
    for c in range(10):
        for r in range(9):
            k = (int(np.floor((9.2 + (c + 0.5) * 0.6 - 10) / 1)), int(np.floor((19.5 + (r + 0.5) * 0.9 - 20) / 2)))
            want |= {(c, r, m): v for a, b, m, v in rows if (a, b) == k}
    assert got == want and None in got.values()
    twice = df.filter("col = 0").unionByName(df.filter("col = 0 and row = 0"))
    report = grids.month_alignment(twice.withColumn("month", twice["month"].cast("date")), df.filter("month = '2000-01-01'").withColumn("month", df["month"].cast("date")))
    assert sorted((r["side"], r["n_valid"], r["n_repeated"]) for r in report.collect()) == [("both", 4, 1), ("only_aligned", 4, 1)]


@pytest.mark.parametrize("most", [200_000, 0])
def test_nearest_feature(spark, monkeypatch, most):
    """A dense crowd, equal distances, twins and outliers; a tree of many levels; by broadcast and by shuffle."""
    monkeypatch.setattr(scratch, "MOST_BROADCAST", most)
    monkeypatch.setattr(grids, "LEAF", 3)
    r = random.Random(5)
    f = [(i, *r.choice([(r.uniform(-9, 9), r.uniform(-9, 9)), (5 + r.random() * 1e-4, 5 + r.random() * 1e-4), (float(r.randint(0, 3)), 1.0)])) for i in range(500)]
    f += [(900, 1e6, -3.0), (901, 0.0, 1.0), (902, None, 2.0)]
    p = [(i, *r.choice([(r.uniform(-12, 12), r.uniform(-12, 12)), (5 + r.random() * 1e-4, 5.0), (r.randint(0, 3) + 0.5, 1.0)])) for i in range(300)] + [(0, 0.5, 1.0), (400, None, 1.0), (401, 9e5, 9e5)]
    points, features = spark.createDataFrame(p, "a int, x double, y double"), spark.createDataFrame(f, "k long, fx double, fy double")
    got = sorted(map(str, ((x["a"], x["k"], x["distance"] and round(x["distance"], 9)) for x in grids.nearest_feature(points, features, "a", "k").collect())))
    want = []
    for a, x, y in p:
        best = min((np.sqrt((u - x) * (u - x) + (v - y) * (v - y)), k) for k, u, v in f if u is not None) if x is not None else (None, None)
        want.append((a, best[1], best[0] if best[0] is None else round(float(best[0]), 9) or best[0] and float(best[0])))
    want = [(a, k, None if d is None else d or 0.0) for a, k, d in want]
    assert got == sorted(map(str, want))


def test_nearest_of_none(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "a int, x double, y double")
    got = grids.nearest_feature(points, spark.createDataFrame([], "k long, fx double, fy double"), "a", "k").collect()
    assert [tuple(r) for r in got] == [(1, None, None)]


def tables(monkeypatch, module):
    """The tables that a module writes from now on: (name, rows, plan)."""
    out, write = [], module.written

    def kept(df, name):
        d = write(df, name)
        out.append((name, d.count(), df._jdf.queryExecution().executedPlan().toString()))
        return d

    monkeypatch.setattr(module, "written", kept)
    return out


def test_nearest_looks_a_place_up_once(spark, monkeypatch):
    """Many points at few places: no table but that of the points has a row for each, and no level sorts its rows."""
    made = tables(monkeypatch, grids)
    points = spark.range(4000).select("id", (grids.F.col("id") % 7 * 1.5).alias("x"), (grids.F.col("id") % 5 * 2.5).alias("y"))
    features = spark.range(900).select(grids.F.col("id").alias("k"), (grids.F.col("id") % 30 * 0.7).alias("fx"), (grids.F.col("id") / 30).alias("fy"))
    got = grids.nearest_feature(points, features, "id", "k")
    assert got.count() == 4000 and got.select("k").distinct().count() <= 35
    assert all(n <= 900 for name, n, _ in made if name != "points")
    assert not any("Window" in plan for _, _, plan in made)


def test_nearest_keeps_few_nodes_a_place(spark, monkeypatch):
    """Points at 3000 places among 20,000 features: some nodes for each place and level, not all children of a node."""
    made = tables(monkeypatch, grids)
    at = lambda c, n: grids.F.pmod(grids.F.xxhash64(c, grids.F.lit(n)), grids.F.lit(100_003)) / 1000.0
    points = spark.range(3000).select("id", at("id", 1).alias("x"), at("id", 2).alias("y"))
    features = spark.range(20_000).select(grids.F.col("id").alias("k"), at("id", 3).alias("fx"), at("id", 4).alias("fy"))
    got = {r["id"]: (r["k"], r["distance"]) for r in grids.nearest_feature(points, features, "id", "k").collect()}
    near = [n for name, n, _ in made if name.startswith("near")]
    assert near and max(near) <= 4 * 3000 and not any("Window" in plan for _, _, plan in made)
    f = features.toPandas()
    for r in points.limit(300).collect():
        d = np.sqrt((f["fx"] - r["x"]) * (f["fx"] - r["x"]) + (f["fy"] - r["y"]) * (f["fy"] - r["y"]))
        assert got[r["id"]] == (f["k"][d == d.min()].min(), d.min())


def test_pairs_of_points_and_polygons_are_not_written(spark, monkeypatch):
    """Points in many polygons: no table has a row for each pair; long lists of a cell are cut into rows."""
    made = tables(monkeypatch, polygons)
    monkeypatch.setattr(polygons, "LISTED", 8)
    shapes = [(k, [(0, 0), (40 + k / 1000, 0), (40, 40), (0, 40)], False) for k in range(60)]
    points = spark.range(2000).select("id", (grids.F.col("id") % 37 + 1.5).alias("x"), (grids.F.col("id") % 31 + 2.5).alias("y"))
    got = polygons.points_in_polygons(points, frame(spark, shapes), "id", "basin")
    assert got.count() == got.distinct().count() == 60 * 2000
    assert max(n for _, n, _ in made) < 60 * 2000
