"""The registry of queries and the series that they read from the tables.

Sites are nations (through customers), time is the month of an order, and the value is the month's order total in
thousands. Weights are the sites' summed positive account balances. Daily series come from the events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xeric.functions.labels import normal_quantile, normal_quantile_sql
from xeric.operators.series import average_rank, calendar_spine, trailing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that gives the same rows."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, month, value) for months with orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("site"))
    month = F.trunc("o_orderdate", "MM").alias("month")
    return orders.join(customers, "o_custkey").groupBy("site", month).agg(F.round(F.sum("o_totalprice") / 1000, 3).alias("value"))


def spined_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, month, value) for every month from a site's first to its last, for all that counts months by rows."""
    return calendar_spine(site_months(spark, sf_dir), ["site"])


def site_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, weight, lat, lon): a weight and a place on a made-up grid for each site."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("site")).agg(F.round(F.sum(F.greatest("c_acctbal", F.lit(0.0))) / 1000, 3).alias("weight"))
    return c.withColumns({"lat": 50.0 + F.col("site") % 5, "lon": 120.0 + F.floor(F.col("site") / 5) * 1.0})


def index_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, month, z): the 3-month sum's empirical index by calendar month, null in months without a sum or 5 of them."""
    k = trailing(spined_months(spark, sf_dir), ["site"], 3).withColumn("k_value", F.round("k_value", 3))
    return empirical_index(k, ["site"])


def index_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of the index that have one, for statistics that don't count months by rows."""
    return index_months(spark, sf_dir).filter("z is not null")


def empirical_index(df: DataFrame, entity: list[str], value: str = "k_value", time: str = "month", least: int = 5, a: float = 0.44) -> DataFrame:
    """Normal scores of plotting positions (rank - a) / (n + 1 - 2a) by entity and calendar month.

    All rows stay, so that months keep their distance; z is null without a value or with under ``least`` of them.
    """
    d = average_rank(df.withColumn("cal_month", F.month(time)), [*entity, "cal_month"], value)
    d = d.withColumn("n", F.count(value).over(Window.partitionBy(*entity, "cal_month")))
    d = d.withColumn("p", F.when(F.col(value).isNotNull() & (F.col("n") >= least), (F.col("rank") - a) / (F.col("n") + (1 - 2 * a))))
    return d.select(*entity, time, "cal_month", "p", F.round(normal_quantile("p"), 10).alias("z"))


def gapped(idx: DataFrame) -> DataFrame:
    """The index with nulls where 7 * site + calendar month is a multiple of 11."""
    return idx.withColumn("z", F.when((F.col("site") * 7 + F.month("month")) % 11 != 0, F.col("z")))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, date, value): the events' daily means by type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("station"), F.to_date("ts").alias("date")).agg(F.round(F.avg("value") + 1e-9, 4).alias("value"))


SITE_MONTHS = """sm AS (SELECT c_nationkey AS site, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  round(sum(o_totalprice) / 1000, 3) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
sp0 AS (SELECT site, CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM sm GROUP BY site),
sp AS (SELECT sp0.site, sp0.month, sm.value FROM sp0 LEFT JOIN sm ON sm.site = sp0.site AND sm.month = sp0.month)"""
WEIGHTS = """sw AS (SELECT c_nationkey AS site, round(sum(greatest(c_acctbal, 0.0)) / 1000, 3) AS weight,
  50.0 + c_nationkey % 5 AS lat, 120.0 + floor(c_nationkey / 5) AS lon FROM customer GROUP BY c_nationkey)"""
_P = "((rk - 0.44) / (n + 0.12))"
_HAS = "k_value IS NOT NULL AND n >= 5"
INDEX = f"""{SITE_MONTHS},
k3 AS (SELECT site, month, round(CASE WHEN count(value) OVER w = 3 THEN sum(value) OVER w END, 3) AS k_value
  FROM sp WINDOW w AS (PARTITION BY site ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
rk3 AS (SELECT *, rank() OVER (PARTITION BY site, month(month) ORDER BY k_value NULLS LAST)
    + (count(k_value) OVER (PARTITION BY site, month(month), k_value) - 1) / 2.0 AS rk,
  count(k_value) OVER (PARTITION BY site, month(month)) AS n FROM k3),
idx AS (SELECT site, month, month(month) AS cal_month, CASE WHEN {_HAS} THEN {_P} END AS p,
  CASE WHEN {_HAS} THEN round({normal_quantile_sql(_P)}, 10) END AS z FROM rk3),
idv AS (SELECT * FROM idx WHERE z IS NOT NULL)"""
GAPPED = f"""{INDEX},
gz AS (SELECT site, month, CASE WHEN (site * 7 + month(month)) % 11 <> 0 THEN z END AS z FROM idx)"""
DAILY = """dy AS (SELECT event_type AS station, CAST(ts AS DATE) AS date, round(avg(value) + 1e-9, 4) AS value FROM events GROUP BY 1, 2)"""
