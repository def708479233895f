"""Tables that cut a long lineage, in the folder that all executors share, and joins that split hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; only where it names nothing (tests, one machine) a local folder is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "xeric")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: what depends on it is not computed twice."""
    path = f"{shared_folder(df.sparkSession)}/xeric/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys with at least this share of the left rows are split, so there can be no more of them than 1 / share.
HOT_SHARE = 1 / 1024
#: Rows of a side that is broadcast.
MOST_BROADCAST = 200_000


def few(df: DataFrame, items: int = 1) -> bool:
    """Whether df, each row of which holds up to so many items, is small enough for a broadcast."""
    most = MOST_BROADCAST // items
    return df.limit(most + 1).count() <= most


def join_split(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", items: int = 1) -> DataFrame:
    """left.join(right, keys, how) for keys of which a few may hold most rows of left; null keys meet nothing.

    A right side of few rows (of few items, where a row holds an array of them) is broadcast. Otherwise rows of a hot key
    are dealt by a hash into parts of at most 1/1024 of all rows and its rows of right go to each part. left is read
    twice, so it should be a table.
    """
    if few(right, items):
        return left.join(F.broadcast(right), keys, how)
    least = max(2, int(left.count() * HOT_SHARE))
    hot = left.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / least).cast("int").alias("_parts")))  # 1024 rows at most
    parts = F.coalesce("_parts", F.lit(1))
    a = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    b = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [*keys, "_part"], how).drop("_part")
