"""Runs queries against their SQL in DuckDB and reports the differences."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

from opsdiff.checks.registry import CHECKS


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def rows_of_spark(df: DataFrame) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(tuple(_plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda n: names[n])
    rows = Counter(tuple(_plain(row[n]) for n in order) for row in result.fetchall())
    return [names[n] for n in order], rows


def main(sf_dir: str, wanted: list[str]) -> int:
    spark, con, bad = session(), connect(sf_dir), 0
    for name, check in CHECKS.items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            columns, got = rows_of_spark(check.run(spark, sf_dir))
        except Exception as error:
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}")
            continue
        seconds = time.time() - started
        if check.sql is None:
            print(f"rows  {name}: {sum(got.values())} rows, {seconds:.1f} s")
            continue
        try:
            names, want = rows_of_sql(con, check.sql)
        except Exception as error:
            bad += 1
            print(f"SQL   {name}: {str(error)[:800]}")
            continue
        if columns != names or got != want:
            bad += 1
            print(f"DIFF  {name}: spark {sum(got.values())} rows, sql {sum(want.values())} rows")
            print("  columns", columns, names) if columns != names else None
            for label, only in [("spark", got - want), ("sql", want - got)]:
                for row in list(only)[:3]:
                    print(f"  only {label}: {dict(zip(columns, row))}")
        else:
            print(f"ok    {name}: {sum(got.values())} rows, {seconds:.1f} s")
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
