"""Regular grids: aligning one to another, and a tree over features for nearest-neighbour search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from xeric.sources.scratch import few, join_split, written


@dataclass(frozen=True)
class Grid:
    """A grid's lower left corner, cell sides and numbers of columns and rows."""

    x0: float
    y0: float
    dx: float
    dy: float
    columns: int
    rows: int

    def cells(self, spark: SparkSession) -> DataFrame:
        """(col, row, x, y): every cell with its centre."""
        at = spark.range(self.columns * self.rows).select((F.col("id") % self.columns).alias("col"), F.floor(F.col("id") / self.columns).alias("row"))
        return at.withColumns({"x": self.x0 + (F.col("col") + 0.5) * self.dx, "y": self.y0 + (F.col("row") + 0.5) * self.dy})

    def cell_of(self, x: Column, y: Column) -> dict[str, Column]:
        """The column and row that hold a place; null off the grid."""
        col, row = F.floor((x - self.x0) / self.dx), F.floor((y - self.y0) / self.dy)
        on = col.between(0, self.columns - 1) & row.between(0, self.rows - 1)
        return {"col": F.when(on, col), "row": F.when(on, row)}


def resample_nearest(values: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """values (col, row, ...) of a source grid on the cells of a target grid: each takes the source cell of its centre.

    Where each target cell looks is arithmetic, and a table of as many rows as the target has cells; values meet it by
    (col, row), whichever side is finer. Target cells off the source grid, and those whose source cell has no row, have none.
    """
    places = target.cells(values.sparkSession)
    look = places.select(F.col("col").alias("_col"), F.col("row").alias("_row"), *[e.alias(n) for n, e in source.cell_of(F.col("x"), F.col("y")).items()])
    met = join_split(values, look.dropna(), ["col", "row"])
    return met.drop("col", "row").withColumnsRenamed({"_col": "col", "_row": "row"}).select(*values.columns)


def month_alignment(aligned: DataFrame, reference: DataFrame, time: str = "month", value: str = "value") -> DataFrame:
    """(month, side, n_valid, n_repeated): whether a month is in both records or in one, by year and month alone.

    n_valid counts the aligned cells with a value and n_repeated the cells that hold a month more than once: a record is
    aligned if every side is "both", some n_valid is above 0 and no n_repeated is.
    """
    month = F.trunc(time, "MM").alias("month")
    cells = aligned.groupBy(month, "col", "row").agg(F.count(value).alias("v"), F.count("*").alias("k"))
    a = cells.groupBy("month").agg(F.sum("v").alias("n_valid"), F.count_if(F.col("k") > 1).alias("n_repeated"))
    b = reference.select(month).distinct().withColumn("_there", F.lit(True))
    side = F.when(F.col("_there") & F.col("n_valid").isNotNull(), "both").when(F.col("_there"), "only_reference").otherwise("only_aligned")
    d = a.join(b, "month", "full")
    return d.select("month", side.alias("side"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"))


#: Children of a node; places of a leaf.
FAN, LEAF = 8, 16


@F.pandas_udf(StructType([StructField("a", LongType()), StructField("z", LongType())]))
def _along_curve(u: pd.Series, v: pd.Series) -> pd.DataFrame:
    """Two words that order places of the unit square along a Hilbert curve, by 62 bits of each coordinate.

    Places beside the square take the number of the nearest one on its sides.
    """
    x, y = [np.minimum(np.clip(np.nan_to_num(c.to_numpy()), 0, 1) * 2.0**62, 2.0**62 - 1024).astype(np.int64) for c in (u, v)]
    words = np.zeros((2, len(x)), np.int64)
    for bit in range(61, -1, -1):
        right, up = (x >> bit) & 1, (y >> bit) & 1
        word = words[0 if bit > 30 else 1]
        word[:] = word << 2 | (3 * right) ^ up
        turn = -(right & (1 - up))  # all ones where both are mirrored
        x, y = x ^ turn, y ^ turn
        x, y = np.where(up, x, y), np.where(up, y, x)
    return pd.DataFrame({"a": words[0], "z": words[1]})


class FeatureTree:
    """A tree of boxes: LEAF places that follow each other along a curve make a leaf, FAN leaves a node, and so on up.

    Features at one place are one, with the smallest key. A node's children with their bounds and first words are one row
    of its level's table, a leaf's places one row of the leaf table. All of it lies in written tables; levels run from
    the root down, and numbers of nodes along the curve.
    """

    def __init__(self, features: DataFrame, key: str) -> None:
        f = features.select(F.col(key), F.col("fx").cast("double").alias("fx"), F.col("fy").cast("double").alias("fy"))
        f = f.filter((F.abs("fx") < float("inf")) & (F.abs("fy") < float("inf"))).groupBy("fx", "fy").agg(F.min(key).alias("key"))
        f = written(f, "places")
        b = f.agg(F.min("fx").alias("x"), F.min("fy").alias("y"), F.max("fx").alias("x2"), F.max("fy").alias("y2"), F.count("*").alias("n")).first()
        self.n, self.levels = b["n"], []
        if not self.n:
            return
        span = max(b["x2"] - b["x"], b["y2"] - b["y"]) or 1.0
        self.word = lambda x, y: _along_curve((F.col(x) - b["x"]) / span, (F.col(y) - b["y"]) / span)
        f = written(f.withColumn("word", self.word("fx", "fy")), "places-on-curve").repartitionByRange("word").sortWithinPartitions("word")
        f = written(f.withColumn("_at", F.monotonically_increasing_id()), "places-in-order")
        part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # as that function numbers rows
        top = f.agg(F.max(part).alias("parts"), F.max(row).alias("rows")).first()
        stride = FAN  # leaves of a part, so that no node has leaves of two parts before all of a part's are in one
        while stride * LEAF <= top["rows"]:
            stride *= FAN
        box = lambda x1, x2, y1, y2: [F.min(x1).alias("x1"), F.max(x2).alias("x2"), F.min(y1).alias("y1"), F.max(y2).alias("y2"), F.min("word").alias("word")]
        leaf = (part * stride + F.floor(row / LEAF)).alias("node")
        level = written(f.groupBy(leaf).agg(F.collect_list(F.struct("fx", "fy", "key")).alias("places"), *box("fx", "fx", "fy", "fy")), "leaves")
        self.leaves, most = level.select("node", "places"), (top["parts"] + 1) * stride
        while most > 1 or not self.levels:
            child = F.struct(F.col("node").alias("id"), "x1", "x2", "y1", "y2", "word")
            up = level.groupBy(F.floor(F.col("node") / FAN).alias("node"))
            level = written(up.agg(F.collect_list(child).alias("children"), *box("x1", "x2", "y1", "y2")), "nodes")
            self.levels.insert(0, level.select("node", "children"))
            most = -(-most // FAN)


def _meet(left: DataFrame, right: DataFrame, items: int) -> DataFrame:
    """left with the nodes that it asks for; a table in between only where the nodes are too many for a broadcast.

    Every node asked for is there. The outer join keeps the planner from computing what is asked for twice, as a filter.
    """
    return left.join(F.broadcast(right), "node", "left") if few(right, items) else join_split(written(left, "asking"), right, ["node"], "left", items)


def nearest_feature(points: DataFrame, features: DataFrame, point_key: str, feature_key: str) -> DataFrame:
    """(point, feature, distance): the nearest of a table of features (fx, fy) for each point (x, y), however many.

    Points at one place are looked up once. A place first goes down the features' tree to the leaf of its own part of the
    curve, whose nearest place bounds its distance; then it goes down again by all children within the bound, and the
    leaves reached are compared. Each level is an equi-join of places and nodes (a broadcast while the nodes are few,
    otherwise a shuffle that splits nodes which many ask for) and no level groups or sorts its rows; one aggregate by
    place ends it. Of features at one distance the smaller key is taken. Points without a place, and all points if there
    is no feature, have a null feature and distance; repeated points each have a row.
    """
    p = written(points.select(F.col(point_key).alias("_point"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    tree = FeatureTree(features, feature_key)
    kind = dict(features.dtypes)[feature_key]
    if not tree.n:
        return p.select(F.col("_point").alias(point_key), F.lit(None).cast(kind).alias(feature_key), F.lit(None).cast("double").alias("distance"))
    x, y, none = F.col("x"), F.col("y"), F.lit(0.0)
    across, along = F.greatest(none, F.col("c.x1") - x, x - F.col("c.x2")), F.greatest(none, F.col("c.y1") - y, y - F.col("c.y2"))
    distance = lambda f: F.sqrt((f["fx"] - x) * (f["fx"] - x) + (f["fy"] - y) * (f["fy"] - y))
    best = F.array_min(F.transform("places", lambda f: F.struct(distance(f).alias("distance"), f["key"].alias("key")))).alias("best")
    own = F.coalesce(F.array_max(F.transform("children", lambda c: F.when(c["word"] <= F.col("word"), c["id"]))), F.array_min("children.id"))

    at = p.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).select("x", "y").distinct().withColumns({"word": tree.word("x", "y"), "node": F.lit(0).cast("long")})
    for nodes in tree.levels:
        at = _meet(at, nodes, FAN).select("x", "y", "word", own.alias("node"))
    at = written(_meet(at, tree.leaves, LEAF).select("x", "y", F.col("node").alias("_first"), best), "first-found")
    bound = (F.col("best.distance") * F.col("best.distance") * (1 + 1e-9)).alias("_bound")
    near = at.select("x", "y", "_first", bound, F.lit(0).cast("long").alias("node"))
    for nodes in tree.levels:
        near = _meet(near, nodes, FAN).select("x", "y", "_first", "_bound", F.explode("children").alias("c"))
        near = near.filter(across * across + along * along <= F.col("_bound")).select("x", "y", "_first", "_bound", F.col("c.id").alias("node"))
        near = written(near, "near-nodes")  # all levels in one generated method would be too long to be compiled
    more = _meet(near.filter("node <> _first").select("x", "y", "node"), tree.leaves, LEAF).select("x", "y", best)
    found = written(at.select("x", "y", "best").unionByName(more).groupBy("x", "y").agg(F.min("best").alias("best")), "found")
    return join_split(p, found, ["x", "y"], "left").select(F.col("_point").alias(point_key), F.col("best.key").alias(feature_key), F.col("best.distance").alias("distance"))
