"""Exact duplicate removal by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_skewed, materialise, read_table, text_of

#: Characters that the prefix hash covers.
PREFIX_CHARS = 96
#: Most (length, prefix hash) keys that are broadcast; 16 bytes each, so 8 MB at most.
BROADCAST_KEYS = 500_000


def _among(rows: DataFrame, keys: DataFrame, on: list[str], how: str, most: int) -> DataFrame:
    """Join keys, a table, by broadcast if there are at most ``most``, else by a shuffle."""
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, on, how)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, broadcast_keys: int = BROADCAST_KEYS, digests: bool = False) -> DataFrame:
    """Group rows whose texts are identical after lower-casing A-Z; the largest id stays.

    Returns one row per input row: ``id_col, keep_id, group_size, kept``. Every step narrows the rows of the next one:
    lengths that one row alone has go first, then prefix hashes that are alone at their length; only the rows left are
    hashed in full. With ``digests`` the others are hashed too, for a last column ``text_sha256``, but are compared with
    none. What is shuffled are lengths, hashes and ids.

    Null text counts as empty, so all null and empty texts are one group. A null id ranks below every other id; a group
    of null ids alone keeps them all. Rows that repeat an id are rows of their own, whatever their texts: each counts in
    ``group_size`` of its own text's group, and is kept if its id is the largest there. An empty table gives an empty
    result. Columns other than the two named are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    length = F.octet_length("body")
    prefix = F.xxhash64(ascii_lower(F.substring("body", 1, prefix_chars)))
    full = F.sha2(ascii_lower(F.col("body")), 256)

    lengths = base.groupBy(length.alias("len")).agg(F.count("*").alias("n")).filter("n > 1").select("len")
    lengths = materialise(lengths, "dedup-lengths")
    same_length = _among(base.select(length.alias("len"), prefix.alias("prefix")), lengths, ["len"], "left_semi", broadcast_keys)
    prefixes = same_length.groupBy("len", "prefix").agg(F.count("*").alias("n")).filter("n > 1")
    prefixes = materialise(prefixes.select("len", "prefix", F.lit(True).alias("shared")), "dedup-prefixes")

    rows = _among(base.withColumns({"len": length, "prefix": prefix}), prefixes, ["len", "prefix"], "left", broadcast_keys)
    rows = materialise(rows.select("id", "len", "shared", (full if digests else F.when(F.col("shared"), full)).alias("digest")), "dedup-rows")
    alive = rows.filter("shared").select("id", "len", "digest")
    groups = alive.groupBy("len", "digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    grouped = join_skewed(alive, materialise(groups, "dedup-groups"), ["len", "digest"], "left", "group_size")
    alone = rows.filter("shared is null").select("id", "len", "digest").withColumns({"keep_id": F.col("id"), "group_size": F.lit(None).cast("long")})
    out = grouped.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("keep_id").eqNullSafe(F.col("id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return out if digests else out.drop("text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), digests=True)


OP2_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM t
"""
