"""Operators on made-up series, readers on small files, and the stream."""

import datetime
import random

import pytest

from xeric.operators import events, indices, physical, series, spatial
from xeric.sources import tables


def month(i):
    return datetime.date(2000 + i // 12, i % 12 + 1, 1)


def machine(values, onset, end):
    """Events of one series by a loop: (first, last, duration)."""
    out, begin = [], None
    for i, v in enumerate(values):
        if begin is None and v is not None and v < onset:
            begin = i
        elif begin is not None and v is not None and v >= end:
            out.append((begin, i - 1))
            begin = None
    if begin is not None:
        out.append((begin, len(values) - 1))
    return out


@pytest.mark.parametrize("onset,end", [(-0.5, -0.5), (-1.0, 0.0)])
def test_events_equal_a_state_machine(spark, onset, end):
    r = random.Random(1)
    all_series = {s: [None if r.random() < 0.12 else r.gauss(0, 1) for _ in range(60)] for s in range(20)}
    rows = [(s, month(i), v) for s, x in all_series.items() for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "site int, month date, value double")
    got = sorted((e["site"], e["start"], e["finish"], e["duration"]) for e in events.detect_events(d, ["site"], onset, end).collect())
    assert got == sorted((s, month(a), month(b), b - a + 1) for s, x in all_series.items() for a, b in machine(x, onset, end))
    dropped = {s: [(i, v) for i, v in enumerate(x) if v is not None] for s, x in all_series.items()}
    got = sorted((e["site"], e["start"], e["duration"]) for e in events.detect_events(d, ["site"], onset, end, nulls="drop").collect())
    assert got == sorted((s, month(x[a][0]), b - a + 1) for s, x in dropped.items() for a, b in machine([v for _, v in x], onset, end))


def test_event_counts_add_up(spark):
    r = random.Random(2)
    d = spark.createDataFrame([(0, month(i), r.gauss(0, 1)) for i in range(240)], "site int, month date, value double")
    e = events.detect_events(d, ["site"], -0.2, 0.4)
    c = events.event_counts(e, ["site"]).first()
    assert c["n_events"] == e.count() and c["d3_6"] + c["d7_12"] + c["d13_up"] + e.filter("duration < 3").count() == c["n_events"]


def test_windows_need_all_values(spark):
    d = spark.createDataFrame([(0, month(i), None if i == 4 else float(i)) for i in range(8)], "site int, month date, value double")
    got = [r["k_value"] for r in series.trailing(d, ["site"], 3).orderBy("month").collect()]
    assert got == [None, None, 3.0, 6.0, None, None, None, 18.0]


def test_weights(spark):
    d = spark.createDataFrame([(0, 1.0), (1, None), (2, -1.0), (3, 3.0), (4, float("nan"))], "site int, weight double")
    assert {r["site"]: r["weight"] for r in spatial.repair_weights(d).collect()} == {0: 1.0, 1: 2.0, 2: 2.0, 3: 3.0, 4: 2.0}


def test_deficit_index_carries_on_over_nulls(spark):
    values = [5.0, None, 3.0, 8.0] * 6
    d = spark.createDataFrame([(0, month(i), v) for i, v in enumerate(values)], "site int, month date, value double")
    rows = physical.storage_deficit_index(d, ["site"], 0.5, 0.1).orderBy("month").collect()
    last, want = None, []
    for r in rows:
        if r["tsd"] is not None:
            last = 0.02 * r["tsd"] if last is None else 0.5 * last + 0.1 * r["tsd"]
        want.append(last)
    assert [r["index"] for r in rows] == pytest.approx(want) if None not in want else [r["index"] for r in rows] == want


def test_patterns_equal_a_decomposition(spark):
    import numpy as np

    from xeric.operators.patterns import eof

    r = np.random.default_rng(1)
    x = r.normal(size=(60, 1)) + 0.5 * r.normal(size=(60, 4))
    d = spark.createDataFrame([(s, month(i), float(x[i, s])) for s in range(4) for i in range(60)], "site int, month date, value double")
    patterns, scores = eof(d, "site", "month", "value", 2)
    from xeric.functions.kernels import principal_components

    want_scores, want, _ = principal_components(x, np.ones(4), 2)
    got = np.array([list(r)[1:] for r in patterns.orderBy("site").collect()])
    assert np.allclose(got, want, atol=1e-8)
    assert np.allclose(np.array([list(r)[1:] for r in scores.orderBy("month").collect()]), want_scores, atol=1e-8)


def test_reading_wide_months(spark, tmp_path):
    (tmp_path / "spi_03.csv").write_text("Year," + ",".join(tables.MONTHS) + "\n2000," + ",".join(str(i) for i in range(12)) + "\n2001,1.5" + "," * 11 + "\n")
    rows = sorted(map(tuple, tables.read_wide_months(spark, str(tmp_path / "spi_03.csv")).collect()))
    assert len(rows) == 13 and rows[0] == (datetime.date(2000, 1, 1), 0.0) and rows[-1] == (datetime.date(2001, 1, 1), 1.5)


def test_reading_month_files(spark, tmp_path):
    for m in (1, 7):
        (tmp_path / f"spi_03_month{m:02d}_x.csv").write_text(f"lon,lat,1950,1951\n-124.5,54.0,{m}.5,NA\n")
    rows = sorted(map(tuple, tables.read_month_files(spark, str(tmp_path)).collect()), key=str)
    assert (-124.5, 54.0, datetime.date(1950, 7, 1), 7.5) in rows and (-124.5, 54.0, datetime.date(1951, 1, 1), None) in rows and len(rows) == 4


def test_reading_hydrographs(spark, tmp_path):
    (tmp_path / "a.rvt").write_text(":ObservationData HYDROGRAPH 08JC001 m3/s\n  2000-01-01 00:00:00 1.0 3\n  5.5\n  -1.2345\n  7\n:EndObservationData\n")
    rows = [(r["site"], r["unit"], str(r["time"])[:10], r["value"]) for r in tables.read_hydrograph(spark, str(tmp_path / "a.rvt")).orderBy("time").collect()]
    assert rows == [("08JC001", "m3/s", "2000-01-01", 5.5), ("08JC001", "m3/s", "2000-01-02", None), ("08JC001", "m3/s", "2000-01-03", 7.0)]


def test_reading_index_tables(spark, tmp_path):
    (tmp_path / "pdo.txt").write_text("PDO header\n1950 " + " ".join(["0.5"] * 11) + " 99.99\n1950 " + " ".join(["0.5"] * 12) + "\nx\n")
    rows = tables.read_year_table(spark, str(tmp_path / "pdo.txt")).collect()
    # The first line of a year counts, also where its value is missing.
    assert len(rows) == 12 and all(r["value"] == (None if r["month"].month == 12 else 0.5) for r in rows)
    (tmp_path / "oni.txt").write_text("SEAS YR TOTAL ANOM\nDJF 1950 24.7 -1.5\nNDJ 1950 25.6 -0.8\n")
    rows = sorted(map(tuple, tables.read_season_table(spark, str(tmp_path / "oni.txt")).collect()))
    assert rows == [(datetime.date(1950, 1, 1), -1.5), (datetime.date(1950, 12, 1), -0.8)]


def test_reading_stations(spark, tmp_path):
    (tmp_path / "q.csv").write_text("STATION_NUMBER,Date,Value\n08JC001,2001-02-03,4.5\n08JC001,02/04/2001,bad\n")
    rows = sorted(map(tuple, tables.read_stations(spark, str(tmp_path / "q.csv")).select("station", "date", "value", "doy").collect()))
    assert rows == [("08JC001", datetime.date(2001, 2, 3), 4.5, 34), ("08JC001", datetime.date(2001, 2, 4), None, 35)]


def test_partitioned_sink_is_pruned(spark, tmp_path):
    d = spark.createDataFrame([("spi", 3, 1.0), ("spi", 6, 2.0)], "index string, scale int, z double")
    tables.write_partitioned(d, str(tmp_path / "out"), ["index", "scale"])
    part = spark.read.parquet(str(tmp_path / "out")).filter("scale = 6")
    assert part.count() == 1 and "PartitionFilters: [isnotnull(scale" in part._jdf.queryExecution().toString()


def test_stream_of_daily_windows(spark, tmp_path):
    from xeric.streaming.windows import daily_windows, run_available

    rows = [(i, datetime.datetime(2024, 1, 1 + i // 10, i % 10), "a" if i % 2 else "b", float(i)) for i in range(60)]
    d = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    run_available(daily_windows(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["event_type"], str(r["day"])): (r["n"], r["mean_value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {}
    for _, ts, k, v in rows:
        whole.setdefault((k, str(ts.date())), []).append(v)
    assert got and all(got[k] == (len(whole[k]), sum(whole[k]) / len(whole[k])) for k in got)
    assert set(whole) - set(got) <= {(k, d) for k, d in whole if d >= "2024-01-05"}  # still open behind the watermark
