"""Every registered query against its SQL counterpart, on the smallest tables."""

import datetime
import math

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (str, datetime.date)):
        return str(v)
    return round(float(v), 9) + 0.0


def table(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted((tuple(map(value, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_its_oracle(spark, duck, name):
    frame = queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))
    result = frame.toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(result)
        return
    columns, rows = table(result)
    expected_columns, expected = table(duck.execute(sql).df())
    assert columns == expected_columns
    assert rows == expected
