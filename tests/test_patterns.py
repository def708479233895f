"""Patterns of a field against numpy's decomposition."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from xeric.operators import patterns
from xeric.operators.patterns import eof

START = datetime.date(1990, 1, 1)


def frame(spark, x, names=None):
    days = [START + datetime.timedelta(days=31 * i) for i in range(len(x))]
    rows = [((names or range(x.shape[1]))[s], days[t], None if np.isnan(x[t, s]) else float(x[t, s])) for t in range(len(x)) for s in range(x.shape[1])]
    return spark.createDataFrame(rows, "site string, month date, value double"), days


@pytest.mark.parametrize(("sites", "columns"), [(5, 96), (60, 96), (60, 46)])
def test_equal_to_a_decomposition(spark, monkeypatch, sites, columns):
    """Few sites (one block holds all), more of them, and a basis that is condensed on the way."""
    monkeypatch.setattr(patterns, "MOST_COLUMNS", columns)
    r = np.random.default_rng(sites)
    x = r.normal(size=(50, 6)) @ r.normal(size=(6, sites)) * np.linspace(1, 3, sites) + r.normal(size=(50, sites))
    x[7, 2] = np.nan
    names = [f"s{i:03d}" for i in range(sites)]
    df, days = frame(spark, x, names)
    got, scores = eof(df, "site", "month", "value", 3, focus=F.col("month") < days[9])
    z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0, ddof=1)
    z = np.delete(z, 7, 0)
    v = np.linalg.svd(z, full_matrices=False)[2][:3].T
    s = z @ v
    sign = np.where(s[:8].mean(0) < 0, -1, 1)
    assert got.columns == ["site", "pattern_1", "pattern_2", "pattern_3"]
    assert np.allclose([list(row)[1:] for row in got.orderBy("site").collect()], v * sign, atol=2e-6)
    assert np.allclose([list(row)[1:] for row in scores.orderBy("month").collect()], s * sign, atol=2e-5)


def test_nothing_complete(spark):
    df, _ = frame(spark, np.array([[1.0, np.nan], [np.nan, 2.0], [2.0, np.nan], [np.nan, 5.0]]))
    got, scores = eof(df, "site", "month", "value", 3)
    assert got.count() == 0 and scores.count() == 0 and got.columns == ["site", "pattern_1", "pattern_2"]
