"""Triage board: one status per host and resource block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdiff.functions.judge import triage_weight
from opsdiff.functions.text import headline
from opsdiff.operators.diff import order_key
from opsdiff.sources.catalog import resource_of
from opsdiff.sources.fixed_values import RESOURCE_BLOCKS


def triage(rows: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Four blocks per host: bad, warn or ok, with the row that decides.

    A block is bad through its core row that got worse by most, else warn
    through the first row in report order that got worse without being core or
    is to be watched (a row that is new or gone counts only if it is core).
    One grouping by host computes all blocks, so every host has all four; hosts
    listed in ``hosts`` but without rows get four times ok.
    """
    shown = F.struct("label", "instance", "a", "b", "delta_pct")
    one_sided = F.col("a").isNull() | F.col("b").isNull()
    worse, watch = F.col("verdict") == "worse", F.col("verdict") == "watch"
    red = worse & F.col("core")
    amber = (worse & ~F.col("core") & ~one_sided) | (watch & (F.col("core") | ~one_sided))
    biggest = F.struct(-triage_weight(F.col("delta_pct")), order_key())

    aggregates = []
    for key, _ in RESOURCE_BLOCKS:
        mine = F.col("res") == key
        aggregates += [
            F.min_by(shown, F.when(mine & red, biggest)).alias(f"{key}_bad"),
            F.min_by(shown, F.when(mine & amber, order_key())).alias(f"{key}_warn"),
        ]
    board = rows.withColumn("res", resource_of(F.col("category"))).groupBy("host").agg(*aggregates)
    if hosts is not None:
        board = hosts.select("host").join(board, "host", "left")

    blocks = [_block(pos, key, label) for pos, (key, label) in enumerate(RESOURCE_BLOCKS)]
    return board.select("host", F.inline(F.array(*blocks)))


def _block(pos: int, key: str, label: str) -> Column:
    bad, warn = f"{key}_bad", f"{key}_warn"

    def text(row: str) -> Column:
        return headline(*[F.col(f"{row}.{c}") for c in ["label", "instance", "a", "b", "delta_pct"]])

    is_bad, is_warn = F.col(bad).isNotNull(), F.col(warn).isNotNull()
    return F.struct(
        F.lit(pos).alias("pos"), F.lit(key).alias("key"), F.lit(label).alias("label"),
        F.when(is_bad, "bad").when(is_warn, "warn").otherwise("ok").alias("status"),
        F.when(is_bad, text(bad)).when(is_warn, text(warn)).otherwise("normal").alias("headline"),
        F.when(is_bad, F.col(f"{bad}.delta_pct")).when(is_warn, F.col(f"{warn}.delta_pct"))
        .alias("worst_pct"),
    )
