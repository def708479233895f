"""Shared pieces of the corpus operators: scratch tables, ASCII folding, word patterns."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
LOWER_TABLE = str.maketrans(UPPER, LOWER)


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by spark.checkpoint.dir.

    Only where the session names none (tests, a single machine) a local folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "xeric")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/xeric/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that materialise wrote and that nothing still to be computed reads."""
    for t in tables:
        path = t.__dict__.get("_scratch_path")
        if path:
            target = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def free_stem(columns: list[str], stem: str) -> str:
    """``stem``, with underscores added until no column's name begins with it, upper and lower case being the same."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(stem.lower()) for c in taken):
        stem += "_"
    return stem


def share_file(spark: SparkSession, data: bytes, stem: str) -> str:
    """Put bytes into the shared folder and send them to all executors as a Spark file; returns its name for SparkFiles."""
    name = f"{stem}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/xeric/{name}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(target.toString())
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z only; every other character stays, so lengths in bytes stay too."""
    return F.translate(c, UPPER, LOWER)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join right, which has one row per key, to left; a null key meets a null key."""
    r = right.withColumnRenamed(key, "_right_key")
    return left.join(r, left[key].eqNullSafe(r["_right_key"]), how).drop("_right_key")


#: Keys that hold at least this share of all rows are salted: there can be no more of them than 1 / share.
HOT_SHARE = 1 / 1024


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", count: str | None = None) -> DataFrame:
    """left.join(right, keys, how), where right has one row per key and a few keys may hold most rows of left.

    Rows of a hot key are dealt by a hash into parts of at most 1 / 1024 of all rows, and its row of right goes to each
    part. Only the at most 1024 hot keys are broadcast. With ``count``, a column of right (and of the result) that says
    how many rows of left a key has, nothing is counted anew. Both sides should be cheap to read twice, as tables are.
    Key columns without null only.
    """
    least = max(2, int(left.count() * HOT_SHARE))
    hot = right if count else left.groupBy(*keys).agg(F.count("*").alias("_n"))
    n = F.col(count or "_n")
    hot = materialise(hot.filter(n >= least).select(*keys, F.ceil(n / least).cast("int").alias("_parts")), "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    parts = F.coalesce("_parts", F.lit(1))
    a = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def parallel_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
