"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

MAX_ROUNDS = 60


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) -> (id, component): every id of a link with the smallest id that it reaches.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the links are stars around their
    smallest id, which takes a logarithmic number of rounds also for long chains. Links stay distributed; each round is
    written to the shared folder. Links from an id to itself and nulls are ignored; repeated links count once.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    state = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written, so that both sides of each join are plain shuffles, whose hot hubs Spark splits.
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least")
        large = materialise(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialise(small.unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), name)
        discard(last, least, large, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
