"""Daily aggregates of a stream of readings, an extension: the batch operators take its output as a daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_windows(stream: DataFrame, keys: tuple[str, ...] = ("event_type",), time: str = "ts", value: str = "value", late: str = "1 day") -> DataFrame:
    """(keys, day, n, mean_value) by tumbling day; readings later than ``late`` behind the newest are dropped."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"))
    return g.select(*keys, F.to_date("window.start").alias("day"), "n", "mean_value")


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what there is and stop; windows are written once the watermark has passed them, each exactly once."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
