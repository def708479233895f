"""What needs a whole table in order, without putting it into one task: false discovery rates and exact quantiles."""

from __future__ import annotations

from itertools import accumulate
from math import ceil, floor, inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xeric.sources.scratch import join_split, written

#: Values of which a quantile's last range is collected, and the places that are read from a range at once.
MOST_VALUES, PLACES = 2_000, 128
#: Groups whose ranges are held in the driver; with more of them no group is searched for by ranges.
MOST_GROUPS = 1_000


def _tasks(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def ordered_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, c, up_to, n): each distinct value of a group with how many rows have it, and have up to it.

    Equal values are counted before any shuffle, so a common one is a single row. Values are then cut into as many
    ranges as there are tasks; counts run within a range, and what lies before a range is added from a table of one row
    a group and range. Nulls and NaNs are left out.
    """
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*groups, value).agg(F.count("*").alias("c"))
    v = written(v, "values")
    n = _tasks(df)
    cuts = v.agg(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    splits = [-inf, *(sorted(set(cuts)) or [0.0]), inf]
    v = v.withColumn("_at", F.col(value).cast("double"))
    v = Bucketizer(splits=splits, inputCol="_at", outputCol="_range").transform(v).drop("_at")
    here = Window.partitionBy(*groups, "_range")
    v = v.withColumn("_in", F.sum("c").over(here.orderBy(value)))
    ranges = v.groupBy(*groups, "_range").agg(F.sum("c").alias("_c"))
    if groups:  # as many rows a group as there are ranges
        by_group = Window.partitionBy(*groups)
        up = by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(*groups, "_range", F.coalesce(F.sum("_c").over(up), F.lit(0)).alias("_before"), F.sum("_c").over(by_group).alias("n"))
    else:
        rows = sorted(ranges.collect())  # one a range
        before = [0, *accumulate(r["_c"] for r in rows)]
        listed = [(r["_range"], b, before[-1]) for r, b in zip(rows, before, strict=False)]
        ranges = F.broadcast(df.sparkSession.createDataFrame(listed, "_range double, _before long, n long"))
    out = _null_safe(v, ranges, [*groups, "_range"])
    return out.select(*groups, value, "c", (F.col("_before") + F.col("_in")).alias("up_to"), "n", "_range")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined to right, where null keys meet."""
    r = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    same = [left[k].eqNullSafe(r[f"_r{i}"]) for i, k in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return left.join(r, on).drop(*[f"_r{i}" for i in range(len(keys))])


def adjusted_values(df: DataFrame, groups: list[str], p: str) -> DataFrame:
    """(groups, p, c, p_adjusted): the Benjamini-Hochberg value of each distinct p of a group.

    It is the least p' n / (rows up to p') over all p' from p up, so it depends on distinct values alone: a running
    minimum within each range of p and, from a table of one row a range, the least of the ranges above.
    """
    q = written(ordered_counts(df, groups, p).withColumn("_q", F.col(p) * F.col("n") / F.col("up_to")), "ranked")
    down = Window.partitionBy(*groups, "_range").orderBy(F.col(p).desc())
    ranges = q.groupBy(*groups, "_range").agg(F.min("_q").alias("_least"))
    if groups:
        above = Window.partitionBy(*groups).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.withColumn("_least", F.min("_least").over(above))
    else:
        rows = sorted(ranges.collect(), reverse=True)  # one a range
        above = [inf, *accumulate((r["_least"] for r in rows), min)]
        ranges = F.broadcast(df.sparkSession.createDataFrame([(r["_range"], a) for r, a in zip(rows, above, strict=False)], "_range double, _least double"))
    out = _null_safe(q.withColumn("_here", F.min("_q").over(down)), ranges, [*groups, "_range"])
    return out.select(*groups, p, "c", F.least(F.lit(1.0), "_here", "_least").alias("p_adjusted"))


def false_discovery(df: DataFrame, groups: list[str], p: str = "p") -> DataFrame:
    """df with Benjamini-Hochberg adjusted p (a double), over the whole table or by group; a null or NaN p stays null.

    Nothing is put in order in one task, whatever the groups' sizes and however many rows share a p: see
    ``adjusted_values``. Its rows, one for each distinct p, go back to df by a join that splits common values.
    """
    there = F.col(p).isNotNull() & ~F.isnan(p)
    table = written(adjusted_values(df, groups, p).drop("c"), "adjusted")
    # A null group is a key like others: each is a flag and a value, so that they meet in an equi-join.
    keys = {f"_k{i}{part}": e for i, g in enumerate(groups) for part, e in (("n", F.col(g).isNull()), ("v", F.coalesce(F.col(g).cast("string"), F.lit(""))))}
    joined = join_split(df.filter(there).withColumns(keys), table.withColumns(keys).drop(*groups), [*keys, p]) if groups else join_split(df.filter(there), table, [p])
    rest = df.filter(F.coalesce(~there, F.lit(True))).withColumn("p_adjusted", F.lit(None).cast("double"))
    return joined.select(*df.columns, "p_adjusted").unionByName(rest)


def exact_quantiles(df: DataFrame, value: str, probs: list[float], groups: list[str] | None = None) -> DataFrame:
    """(groups, n, quantiles): linear-interpolated (type 7) quantiles as an array, over the table or by group.

    Each quantile lies between two ranks. A rank is sought in an open range of values: one pass counts the rows at and
    between the range's ends and reads 128 approximate places inside; those around the rank are the next range. Ends
    that hold the rank are the answer, so many equal values end the search; a range of 2000 rows or fewer is collected.
    A pass hands on a sketch a range, never the rows, and each divides a range by some 40 (1e12 rows: seven passes).
    A table of more than 1000 groups counts its distinct values by group instead. Nulls, NaNs and infinities have no part; groups
    without a value have no row, and an empty table gives none.
    """
    groups = groups or []
    c = F.col(value).cast("double")
    d = written(df.select(*groups, c.alias("_v")).filter(F.abs("_v") < inf), "quantile-values")
    sizes = d.groupBy(*groups).agg(F.count("*").alias("n"))
    probs = [float(q) for q in probs]
    known = sizes.filter("n > 0").limit(MOST_GROUPS + 1).collect() if groups else [r for r in sizes.collect() if r["n"]]
    if len(known) > MOST_GROUPS:
        counted = d.groupBy(*groups, "_v").agg(F.count("*").alias("_c"))
        return counted.groupBy(*groups).agg(F.sum("_c").alias("n"), F.percentile("_v", probs, F.col("_c")).alias("quantiles"))
    ranks = [sorted({r for q in probs for r in (floor((k["n"] - 1) * q), ceil((k["n"] - 1) * q))}) for k in known]
    found = _values_at(d, groups, known, ranks)
    rows = []
    for i, k in enumerate(known):
        out = []
        for q in probs:
            h = (k["n"] - 1) * q
            a, b = found[i, floor(h)], found[i, ceil(h)]
            out.append(a if a == b else a + (b - a) * (h - floor(h)))
        rows.append((*[k[g] for g in groups], k["n"], out))
    kinds = dict(d.dtypes)
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in groups], "n long", "quantiles array<double>"])
    return df.sparkSession.createDataFrame(rows, schema)


def _values_at(d: DataFrame, groups: list[str], known: list, ranks: list[list[int]]) -> dict[tuple[int, int], float]:
    """The value at each rank (from 0) of each group, by counted narrowing ranges."""
    spark = d.sparkSession
    if groups:  # one row a group
        kinds = dict(d.dtypes)
        numbers = spark.createDataFrame([(*[k[g] for g in groups], i) for i, k in enumerate(known)], ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", _g int")
        d = _null_safe(d, F.broadcast(numbers), groups).select("_g", "_v")
    else:
        d = d.select(F.lit(0).alias("_g"), "_v")
    v, low, high, a, b = (F.col(c) for c in ("_v", "_low", "_high", "_a", "_b"))
    inside = F.when((v > a) & (v < b), v)
    places = [i / PLACES for i in range(PLACES + 1)]
    found: dict[tuple[int, int], float] = {}
    # An open search: its range (both ends excluded), how many rows lie below the range, and the ends that are tried in it.
    searches = {(g, r): (-inf, inf, 0, -inf, inf) for g, rs in enumerate(ranks) for r in rs}
    while searches:
        asked = list(searches)
        listed = [(g, i, *searches[g, r][:2], *searches[g, r][3:]) for i, (g, r) in enumerate(asked)]
        spans = spark.createDataFrame(listed, "_g int, _s int, _low double, _high double, _a double, _b double")  # a row a rank
        rows = d.join(F.broadcast(spans), "_g").filter((v > low) & (v < high))
        counts = [F.count_if(v < a).alias("below"), F.count_if(v == a).alias("at_a"), F.count(inside).alias("n"), F.count_if(v == b).alias("at_b")]
        small = []
        for row in rows.groupBy("_s").agg(*counts, F.percentile_approx(inside, places, 20 * PLACES).alias("places")).collect():
            g, r = asked[row["_s"]]
            low0, high0, before, a0, b0 = searches.pop((g, r))
            first = before + row["below"]
            start = first + row["at_a"]
            end = start + row["n"]
            if r < first:  # the sketch's places lay beside the rank
                searches[g, r] = (low0, a0, before, low0, a0)
            elif r < start:
                found[g, r] = a0
            elif r < end and row["n"] <= MOST_VALUES:
                small.append((g, row["_s"], a0, b0, start))
            elif r < end:
                at = (r - start) / row["n"] * PLACES
                searches[g, r] = (a0, b0, start, row["places"][max(0, floor(at) - 1)], row["places"][min(PLACES, ceil(at) + 1)])
            elif r < end + row["at_b"]:
                found[g, r] = b0
            else:
                searches[g, r] = (b0, high0, end + row["at_b"], b0, high0)
        if small:
            spans = spark.createDataFrame(small, "_g int, _s int, _a double, _b double, _start long")
            rows = d.join(F.broadcast(spans), "_g").filter((v > a) & (v < b)).groupBy("_s", "_start")
            for row in rows.agg(F.sort_array(F.collect_list("_v")).alias("v")).collect():  # 2000 values each
                g, r = asked[row["_s"]]
                found[g, r] = row["v"][r - row["_start"]]
    return found


def at_or_below(values: Column, edges: list[float]) -> Column:
    """How many of a few edges lie below a value."""
    return sum([(values > F.lit(float(x))).cast("int") for x in edges], F.lit(0))
