"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from xeric.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()[:10]
    if isinstance(v, (bool, str)):
        return str(v)
    try:
        return repr(round(float(v), 9) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows(d):
    return sorted(str([plain(v) for v in r]) for r in d[sorted(d.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    # At the smallest size no month has all sites, and few have the months that these need.
    short = ("eof_scores", "area_frequency_curves", "consensus_change", "noise_envelope", "moderated_mediation", "streamflow_index")
    assert QUERIES[name](spark, DATA).count() >= (name not in short)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["filtered_flow"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "o_comment" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_entry_works_without_the_corpus_part():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
