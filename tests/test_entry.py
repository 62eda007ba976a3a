"""Every registered query gives the rows of its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from opsdiff.checks.compare import connect, rows_of_spark, rows_of_sql

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_smoke(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    # No pairs of all rows, and no window over everything in one task.
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = df._jdf.queryExecution().explainString(mode)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Window .*\n.*\n.*Exchange SinglePartition", plan)
    columns, got = rows_of_spark(df)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    names, want = rows_of_sql(con, sql)
    assert columns == names
    assert got == want
