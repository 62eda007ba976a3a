"""Reports as JSON: one object per line and one folder per part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, part: str) -> DataFrame:
    """(part, json) with every row as one JSON object; NULL stays in it as null."""
    return df.select(
        F.lit(part).alias("part"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"),
    )


def write_json(parts: dict[str, DataFrame], path: str) -> None:
    """Writes every part of a report to its own folder below ``path``."""
    for name, df in parts.items():
        json_rows(df, name).select("json").write.mode("overwrite").text(f"{path}/{name}")
