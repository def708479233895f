"""Readers and reshapers of the text and table layouts that hydro-climatic archives use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Three-month season codes of the oceanic index and the month that each is centred on.
SEASON_MONTH = {"DJF": 1, "JFM": 2, "FMA": 3, "MAM": 4, "AMJ": 5, "MJJ": 6, "JJA": 7, "JAS": 8, "ASO": 9, "SON": 10, "OND": 11, "NDJ": 12}


def wide_months(df: DataFrame, entity: list[str], value: str = "value", time: str = "month") -> DataFrame:
    """One row per entity and year, a column per calendar month."""
    d = df.select(*entity, F.year(time).alias("year"), F.month(time).alias("_m"), F.col(value).alias("_v"))
    out = d.groupBy(*entity, "year").pivot("_m", list(range(1, 13))).agg(F.max("_v"))
    return out.select(*entity, "year", *[F.col(str(i)).alias(m) for i, m in enumerate(MONTHS, 1)])


def unpivot_months(wide: DataFrame, entity: list[str], year: str = "year") -> DataFrame:
    """A year and twelve month columns to (entity, month, value)."""
    long = wide.unpivot([*entity, year], list(MONTHS), "_name", "value")
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.col("_name")).cast("int")
    return long.select(*entity, F.make_date(F.col(year), number, F.lit(1)).alias("month"), "value")


def year_columns_to_long(wide: DataFrame, entity: list[str]) -> DataFrame:
    """Columns named by a year to (entity, year, value)."""
    years = [c for c in wide.columns if c.isdigit() and len(c) == 4]
    return wide.unpivot(entity, years, "year", "value").withColumn("year", F.col("year").cast("int"))


def read_wide_months(spark: SparkSession, path: str) -> DataFrame:
    """CSV of Year, Jan .. Dec to (month, value)."""
    schema = "Year int, " + ", ".join(f"{m} double" for m in MONTHS)
    return unpivot_months(spark.read.csv(path, header=True, schema=schema), [], "Year").filter("value is not null")


def read_month_files(spark: SparkSession, path: str) -> DataFrame:
    """Pixel CSVs of lon, lat and year columns, one per calendar month named ``month07`` in the file name."""
    raw = spark.read.csv(path, header=True, inferSchema=False).withColumn("_m", F.regexp_extract(F.input_file_name(), r"month(\d{2})", 1).cast("int"))
    long = year_columns_to_long(raw, ["lon", "lat", "_m"])
    return long.select(F.col("lon").cast("double"), F.col("lat").cast("double"), F.make_date("year", "_m", F.lit(1)).alias("month"), F.expr("try_cast(value AS double)").alias("value"))


def clean(value: str = "value", sentinels: tuple[float, ...] = (-9999.0,), most: float = 9e36) -> Column:
    """Null for sentinels, NaN and infinities."""
    v = F.col(value)
    return F.when(~F.isnan(v) & (F.abs(v) < most) & ~v.isin(*sentinels), v)


def read_hydrograph(spark: SparkSession, path: str, missing: float = -1.2345) -> DataFrame:
    """``.rvt`` text: ':ObservationData type id unit', then 'date time step n', then a value a line."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("lines"))
    head = F.split(F.element_at(F.filter("lines", lambda x: x.startswith(":ObservationData")), 1), r"\s+")
    body = F.filter("lines", lambda x: (F.length(F.trim(x)) > 0) & ~x.startswith(":") & ~x.startswith("#"))
    d = text.select("file", head.alias("head"), body.alias("body")).withColumn("start", F.split(F.trim(F.col("body")[0]), r"\s+"))
    rows = d.select("file", F.col("head")[1].alias("kind"), F.col("head")[2].alias("site"), F.col("head")[3].alias("unit"), "start", F.posexplode(F.slice("body", 2, F.size("body"))).alias("pos", "raw"))
    begin = F.unix_timestamp(F.concat_ws(" ", F.col("start")[0], F.substring(F.col("start")[1], 1, 8)), "yyyy-MM-dd HH:mm:ss")
    step = F.col("start")[2].cast("double") * 86400
    v = F.trim("raw").cast("double")
    return rows.filter(F.col("pos") < F.col("start")[3].cast("int")).select("file", "kind", "site", "unit", F.timestamp_seconds(begin + F.col("pos") * step).alias("time"), F.when(F.abs(v - missing) > 1e-9, v).alias("value"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The cells ``c`` of each line, and its place (file, byte block and offset within it), which orders lines."""
    rows = spark.read.text(path).withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})
    return rows.select(F.struct("_file", "_block", F.monotonically_increasing_id().alias("at")).alias("line"), F.split(F.trim("value"), r"\s+").alias("c"))


def read_year_table(spark: SparkSession, path: str, missing_from: float = 9.99) -> DataFrame:
    """A climate index as lines of a year and twelve values to (month, value), the first value of a month; others skipped."""
    cells = _lines(spark, path).filter((F.size("c") == 13) & F.col("c")[0].rlike(r"^\d{4}$"))
    long = cells.select("line", F.col("c")[0].cast("int").alias("y"), F.posexplode(F.slice("c", 2, 12)).alias("m", "raw"))
    v = F.expr("try_cast(raw AS double)")
    out = long.select("line", F.make_date("y", F.col("m") + 1, F.lit(1)).alias("month"), F.when(F.abs(v) < missing_from, v).alias("value"))
    return out.groupBy("month").agg(F.min_by("value", "line").alias("value"))


def read_season_table(spark: SparkSession, path: str) -> DataFrame:
    """Lines of season code, year, total and anomaly to (month, value), the first line of a month."""
    cells = _lines(spark, path).filter(F.size("c") == 4)
    number = F.create_map(*[F.lit(x) for kv in SEASON_MONTH.items() for x in kv])[F.col("c")[0]]
    return cells.filter(F.col("c")[1].rlike(r"^\d{4}$") & number.isNotNull()).select("line", F.make_date(F.col("c")[1].cast("int"), number, F.lit(1)).alias("month"), F.col("c")[3].cast("double").alias("value")).groupBy("month").agg(F.min_by("value", "line").alias("value"))


def first_name(columns: list[str], candidates: tuple[str, ...]) -> str:
    """The first candidate that is a column, compared by letters and digits only."""
    canonical = {"".join(c for c in x.lower() if c.isalnum()): x for x in reversed(columns)}
    for c in candidates:
        if (key := "".join(x for x in c.lower() if x.isalnum())) in canonical:
            return canonical[key]
    raise KeyError(f"none of {candidates} among {columns}")


def any_date(column: str, formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy")) -> Column:
    """The first format that reads the date."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.col(column), F.lit(f))) for f in formats])


def read_stations(spark: SparkSession, path: str, station: tuple[str, ...] = ("station_id", "STATION_NUMBER", "ID"), date: tuple[str, ...] = ("date", "Date"), value: tuple[str, ...] = ("discharge", "Value", "flow")) -> DataFrame:
    """Station CSVs whose columns go by one of several names to (station, date, value, year, month, day, doy)."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    s, d, v = (first_name(raw.columns, names) for names in (station, date, value))
    out = raw.select(F.col(s).alias("station"), any_date(d).alias("date"), F.expr(f"try_cast(`{v}` AS double)").alias("value"))
    return out.withColumns({"year": F.year("date"), "month": F.month("date"), "day": F.day("date"), "doy": F.dayofyear("date")})


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet by partition keys, so that a reader of one index and scale reads only that."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)
