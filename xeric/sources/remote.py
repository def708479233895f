"""Tables behind a web interface: pages by offset, retries, HTML tables, and a local copy of an index."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = 10_000


def with_retries(fetch: Callable[[int], str], tries: int = 3, wait: float = 1.0, factor: float = 2.0) -> Callable[[int], str]:
    """``fetch`` called again after a failure, each time after a longer wait; the last failure is raised."""

    def call(offset: int) -> str:
        for k in range(tries):
            try:
                return fetch(offset)
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(wait * factor**k)
        raise RuntimeError("no tries")

    return call


def read_pages(spark: SparkSession, fetch: Callable[[int], str], total: int, schema: str, page: int = PAGE, key: list[str] | None = None) -> DataFrame:
    """Rows of a JSON interface that gives ``page`` of ``total`` rows at an offset, as an array; pages are got by tasks.

    ``fetch`` maps an offset to JSON text and must be safe to call again, as a lost task is. Rows that repeat ``key``
    (all columns if none) count once: that of the least offset, then the first in its page.
    """

    def run(batches):
        for pdf in batches:
            yield pdf.assign(body=[fetch(int(o)) for o in pdf["id"]])

    offsets = spark.range(0, max(0, total), page)
    bodies = offsets.repartition(max(1, -(-total // page)), "id").mapInPandas(run, "id long, body string")
    rows = bodies.select("id", F.posexplode(F.from_json("body", f"array<struct<{schema}>>")).alias("pos", "r"))
    names = key or rows.select("r.*").columns
    first = rows.groupBy(*[F.col(f"r.{c}").alias(c) for c in names]).agg(F.min(F.struct("id", "pos", "r")).alias("m"))
    return first.select("m.r.*")


def html_rows(html: Column) -> Column:
    """All table rows of a page as arrays of their cells' text, without tags; &amp; and its like are left as they are."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]*>", "")))
    return F.transform(rows, cells)


def html_table(pages: DataFrame, key: str, columns: list[str], html: str = "html") -> DataFrame:
    """Rows of the pages' tables that have as many cells as there are columns, in page order as ``row``."""
    rows = pages.select(key, F.posexplode(html_rows(F.col(html))).alias("row", "c")).filter(F.size("c") == len(columns))
    return rows.select(key, "row", *[F.col("c")[i].alias(c) for i, c in enumerate(columns)])


def cached_index(spark: SparkSession, path: str, make: Callable[[], DataFrame], first_year: int, last_year: int, time_col: str = "month") -> DataFrame:
    """An index read from the Parquet copy at ``path``, which ``make`` fills the first time, within a window of years."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).filter(F.year(time_col).between(first_year, last_year))


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Series as CSV with a header, in folders by the partition columns."""
    (df.write.partitionBy(*partition_by) if partition_by else df.write).mode("overwrite").csv(path, header=True)
