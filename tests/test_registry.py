"""Every query against its SQL counterpart, and the shape of the plans."""

import decimal
import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from logtide.functions import timestamps as tm
from logtide.operators import records, windows
from logtide.registry.oracles import ORACLES
from logtide.registry.queries import AS_OF, QUERIES, labelled_events
from logtide.sources import tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = sql.execute(ORACLES[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == columns
    wanted = sorted(tuple(plain(row[found.index(c)]) for c in columns) for row in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == wanted


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry_point.queries()) == set(QUERIES) | set(entry_point.CORPUS_QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_shuffles_lines_once_and_per_chunk(spark):
    parsed = records.parse_lines(tables.event_lines(spark, DATA), AS_OF)
    plan = plan_of(records.fold_chunks(parsed))
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(shuffles) == 1 and "chunk" in shuffles[0]


def test_no_cartesian_products(spark):
    labelled = labelled_events(spark, DATA)
    merged, placed = windows.merge_windows(windows.tumbling_windows(labelled))
    for df in (merged, windows.anomaly_items(labelled, placed, merged)):
        assert "CartesianProduct" not in plan_of(df)


def test_scan_reads_needed_columns_and_pushes_filters(spark):
    df = tables.table(spark, DATA, "events").where("event_type = 'error'").select("event_id")
    plan = plan_of(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_timestamp_expression_is_built_once():
    assert tm.extract_timestamp is not None
    a = tm._expression("value", AS_OF, tuple(tm.default_order()), "UTC", 1900)
    assert a is tm._expression("value", AS_OF, tuple(tm.default_order()), "UTC", 1900)
