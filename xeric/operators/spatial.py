"""Weighted aggregation over cells and stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import at_or_below, exact_quantiles


def repair_weights(cells: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights that are null, NaN or not above 0 become the median of the good ones, or 1 if there is none."""
    good = F.when(F.col(weight).isNotNull() & ~F.isnan(weight) & (F.col(weight) > 0), F.col(weight))
    middle = exact_quantiles(cells.select(good.alias("w")), "w", [0.5]).collect()
    return cells.withColumn(weight, F.coalesce(good, F.lit(middle[0]["quantiles"][0] if middle else 1.0)))


def weighted_mean(df: DataFrame, keys: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """Mean over the cells that have a value, weights renormalised over those, and the share of weight they hold."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(w)).alias("w_mean"), (100 * F.try_divide(F.sum(w), F.sum(weight))).alias("pct_covered"))


def layer_statistics(df: DataFrame, keys: list[str], threshold: float, value: str = "value", area: str = "area") -> DataFrame:
    """Mean, valid share and share at or below the threshold, of all area; and extent below it, of valid area."""
    valid = F.when(F.col(value).isNotNull(), F.col(area))
    dry = F.when(F.col(value) <= threshold, F.col(area))
    below = F.when(F.col(value) < threshold, F.col(area))
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean_value"), F.try_divide(F.sum(valid), F.sum(area)).alias("valid_fraction"),
        F.try_divide(F.coalesce(F.sum(dry), F.lit(0.0)), F.sum(area)).alias("drought_fraction"),
        (100 * F.try_divide(F.coalesce(F.sum(below), F.lit(0.0)), F.sum(valid))).alias("extent_pct"),
    )


def area_severity(df: DataFrame, keys: list[str], threshold: float, value: str = "value") -> DataFrame:
    """Share of cells below the threshold, and their mean deficit, 0 if there is none."""
    dry = F.col(value) < threshold
    return df.groupBy(*keys).agg((100 * F.avg(F.when(F.col(value).isNotNull(), dry.cast("int")))).alias("area_pct"), F.coalesce(F.avg(F.when(dry, threshold - F.col(value))), F.lit(0.0)).alias("severity"))


def grid_cell(df: DataFrame, x0: float, y0: float, step: float, x: str = "x", y: str = "y") -> DataFrame:
    """The cell of a regular grid in which each point lies."""
    return df.withColumns({"col": F.floor((F.col(x) - x0) / step), "row": F.floor((F.col(y) - y0) / step)})


def in_polygon(df: DataFrame, ring: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Rows inside a ring, by ray casting in column expressions after a bounding-box filter."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = df.filter(F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys)))
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            spans = (F.col(y) < max(y1, y2)) & (F.col(y) >= min(y1, y2))
            crossings = crossings + (spans & (F.col(x) < (x2 - x1) * (F.col(y) - y1) / (y2 - y1) + x1)).cast("int")
    return box.filter(crossings % 2 == 1)


def rank_top(df: DataFrame, groups: list[str], order: list, n: int, ties: bool = False) -> DataFrame:
    """The first n rows of each group; with ``ties`` all rows that share the last place."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_n", F.rank().over(w) if ties else F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def build_regions(pixels: DataFrame, pixel: str, bands: int = 4, least: int = 8) -> DataFrame:
    """Regions of pixels (pixel, x, y, elevation, aspect): elevation quantile band by aspect quarter, small ones merged.

    Aspect is in degrees from north and 0 for flat; regions of under ``least`` pixels go to the large region with the
    nearest centroid (of equals the smaller number). Band edges are type-7 quantiles. What is broadcast is one row a
    region, of which there are at most 5 * bands.
    """
    edges = exact_quantiles(pixels, "elevation", [i / bands for i in range(1, bands)]).collect()
    band = at_or_below(F.col("elevation"), sorted(set(edges[0]["quantiles"])) if edges else [])
    quarter = F.when(F.col("aspect").isNull() | (F.col("aspect") < 0), 0).otherwise(F.floor(((F.col("aspect") + 45) % 360) / 90) + 1)
    d = pixels.filter("elevation is not null").withColumn("_region", (band * 5 + quarter).cast("int"))
    centres = d.groupBy("_region").agg(F.count("*").alias("_n"), F.avg("x").alias("_x"), F.avg("y").alias("_y"))
    large = centres.filter(F.col("_n") >= least).select(F.col("_region").alias("_to"), F.col("_x").alias("_tx"), F.col("_y").alias("_ty"))
    far = F.struct((F.pow(F.col("_x") - F.col("_tx"), 2) + F.pow(F.col("_y") - F.col("_ty"), 2)).alias("d"), F.col("_to").alias("to"))
    merged = centres.filter(F.col("_n") < least).join(F.broadcast(large)).groupBy("_region").agg(F.min(far)["to"].alias("_to"))
    return d.join(F.broadcast(merged), "_region", "left").select(pixel, F.coalesce("_to", "_region").alias("region"))
