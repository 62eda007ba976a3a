"""Queries over the given tables, each with the SQL that has to give the same rows.

Numbers are rounded to four decimals on both sides, because sums of doubles
may differ in the last bits.  The given values have two decimals, so that many
means are exact ties for rounding; a tiny shift on both sides moves them off.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None):
    def register(run):
        if name in CHECKS:
            raise ValueError(f"query registered twice: {name}")
        CHECKS[name] = Check(run, sql)
        return run

    return register


def near(value):
    return F.round((F.col(value) if isinstance(value, str) else value) + 3e-8, 4)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: near(c) for c in columns})
