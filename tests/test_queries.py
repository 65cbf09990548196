"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quern.operators import vector
from quern.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False, name=None):
        out.append(tuple("" if x is None or (not isinstance(x, list) and pd.isna(x)) else pd.Timestamp(x).value // 1000 if hasattr(x, "isoformat") else round(float(x), 7) + 0.0 if isinstance(x, float) else str(x) for x in row))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, data, con, name):
    got = catalogue.queries()[name](spark, data).toPandas()
    want = con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["envelope_partition", "ir_metrics_per_query", "pool_depth_sweep", "resampling_tests"])
def test_legs_by_blocks_equal_sql(spark, data, con, monkeypatch, name):
    plans, real = [], vector.topk

    def topk(*args):
        out = real(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(vector, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(vector, "topk", topk)
    test_query_equals_sql(spark, data, con, name)
    assert plans and not any("Broadcast" in p for p in plans)
