"""Metric rows of two windows: join, judgement, order, counts and folding.

A row is one series of one host.  Report order is a sortable key, never a
global sort: category, position in the catalog, instance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsdiff.functions.judge import (
    ROW_KINDS, display_weight, effective_threshold, judge, rank_in, row_kind,
)
from opsdiff.operators.chunks import sortable
from opsdiff.operators.ordinals import with_ordinal
from opsdiff.operators.windows import Windows, paired_means
from opsdiff.sources.catalog import Catalog, is_core

FOLD_ABOVE = 4
MIN_SCALE = 100.0
MAX_BAR = 50.0


def order_key() -> Column:
    """Report order inside a host."""
    return F.struct("cat_idx", "metric_idx", "instance")


def judge_means(means: DataFrame, catalog: Catalog) -> DataFrame:
    """Catalog lookup and judgement of paired means; metrics not in the catalog drop out."""
    a, b = F.col("a"), F.col("b")
    known = means.join(
        catalog.metrics.withColumnRenamed("threshold_pct", "own_threshold"), "metric"
    )
    verdict = judge(
        a, b, F.col("polarity"),
        effective_threshold(F.col("own_threshold"), F.col("threshold_pct")), F.col("min_abs"),
    )
    return known.withColumn("j", verdict).select(
        "host", "metric", "instance", "label", "category", "units", "a", "b",
        "j.delta_pct", "j.exceeded", "j.verdict",
        row_kind(a, b, F.col("j.verdict")).alias("kind"),
        is_core(F.col("metric")).alias("core"), "fold", "cat_idx", "metric_idx",
    )


def window_diff(
    samples: DataFrame, catalog: Catalog, windows: Windows | DataFrame
) -> DataFrame:
    """Every catalogued series of windows A and B with its change and verdict.

    One scan and one grouping serve both windows; a series that only one of
    them has keeps NULL on the other side, as a full outer join would give.
    """
    if catalog.names is None:
        samples = samples.join(catalog.metrics.select("metric"), "metric", "left_semi")
    return judge_means(paired_means(samples, windows, catalog.names), catalog)


def means_diff(
    means_a: DataFrame, means_b: DataFrame, catalog: Catalog, threshold_pct: float
) -> DataFrame:
    """window_diff for two tables of ready-made means, such as parsed summary texts.

    Where a table has a series twice, its last row (column ``seq``) counts.
    """
    def side(means: DataFrame, name: str) -> DataFrame:
        return means.withColumns({
            "side": F.lit(name), "seq": F.col("seq") if "seq" in means.columns else F.lit(0),
        }).select("host", "metric", "instance", "side", "seq", "val", "units")

    last = F.struct("seq", "val", "units")
    both = side(means_a, "a").unionByName(side(means_b, "b"))
    paired = both.groupBy(*sortable(["host", "metric", "instance"])).agg(
        F.max(F.when(F.col("side") == "a", last)).alias("in_a"),
        F.max(F.when(F.col("side") == "b", last)).alias("in_b"),
    )
    return judge_means(
        paired.select(
            "host", "metric", "instance",
            F.coalesce("in_b.units", "in_a.units").alias("units"),
            F.lit(float(threshold_pct)).alias("threshold_pct"),
            F.col("in_a.val").alias("a"), F.col("in_b.val").alias("b"),
        ),
        catalog,
    )


def focus(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """Drops the flat rows."""
    return rows.where(F.col(kind) != "flat")


REPORT_ORDER = ["host", "cat_idx", "metric_idx", "instance"]


def in_report_order(rows: DataFrame) -> DataFrame:
    """Range-sorted for writing; not meant for use inside other operators."""
    return rows.orderBy(*REPORT_ORDER)


def numbered_rows(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Rows with ``n``, their place in the report of all hosts."""
    return with_ordinal(rows, REPORT_ORDER, "n", path=path)


def verdict_counts(rows: DataFrame) -> DataFrame:
    """Rows per kind, one line per host."""
    return rows.groupBy("host").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ROW_KINDS]
    )


def category_counts(rows: DataFrame) -> DataFrame:
    """Rows per category, after focus() or before."""
    return rows.groupBy("host", "category").agg(F.count("*").alias("items"))


def regressed(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Alert flag per host: a critical finding, or any row got worse."""
    worse = rows.groupBy("host").agg(F.bool_or(F.col("verdict") == "worse").alias("flag"))
    crit = findings.groupBy("host").agg(F.bool_or(F.col("severity") == "crit").alias("flag"))
    return worse.unionByName(crit).groupBy("host").agg(F.bool_or("flag").alias("regressed"))


def with_bars(rows: DataFrame) -> DataFrame:
    """Adds ``scale`` (greatest change of the host, at least 100) and ``bar`` (0..50).

    The scale is an aggregate joined back, not a window over the host, so a
    host with very many rows is not pulled into one task.
    """
    scales = rows.groupBy("host").agg(
        F.greatest(F.lit(MIN_SCALE), F.max(F.abs("delta_pct"))).alias("scale")
    )
    # A row without a percentage has no bar.
    length = F.least(F.lit(MAX_BAR), F.abs("delta_pct") / F.col("scale") * MAX_BAR)
    return rows.join(scales, "host").withColumn(
        "bar", F.when(F.col("delta_pct").isNotNull(), length)
    )


def top_worst(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n worst rows of every host by size of change; 0 -> x counts as no change here.

    Spark cuts every partition to n rows per host before the shuffle.
    """
    weight = display_weight(F.col("delta_pct"), F.col("a"), F.col("b"))
    ranked = Window.partitionBy("host").orderBy(
        F.desc("weight"), "cat_idx", "metric_idx", "instance"
    )
    return (
        rows.where(F.col("kind") == "worse")
        .withColumn("weight", weight)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= n)
    )


def fold_instances(rows: DataFrame) -> DataFrame:
    """Folds the instances of foldable metrics with more than four of them into one row.

    A folded row has ``instances`` > 1, the worst instance's change and the
    range of B; all other rows pass through with ``instances`` 1.
    """
    weight = display_weight(F.col("delta_pct"), F.col("a"), F.col("b"))
    worst_first = F.struct(
        rank_in(F.col("kind"), ["worse", "new", "watch", "gone", "better", "flat"]),
        -weight, F.col("instance"),
    )
    foldable = rows.where("fold")
    groups = (
        foldable.groupBy("host", "metric")
        .agg(
            F.count("*").alias("instances"),
            F.min_by(
                F.struct("instance", "label", "category", "units", "delta_pct", "kind",
                         "cat_idx", "metric_idx"),
                worst_first,
            ).alias("w"),
            F.min("b").alias("b_min"),
            F.max("b").alias("b_max"),
        )
        .where(F.col("instances") > FOLD_ABOVE)
    )
    folded = groups.select(
        "host", "metric", "instances", "w.instance", "w.label", "w.category", "w.units",
        "w.delta_pct", "w.kind", "b_min", "b_max", "w.cat_idx", "w.metric_idx",
    )
    single = rows.join(groups.select("host", "metric"), ["host", "metric"], "left_anti").select(
        "host", "metric", F.lit(1).cast("bigint").alias("instances"), "instance", "label",
        "category", "units", "delta_pct", "kind", F.col("b").alias("b_min"),
        F.col("b").alias("b_max"), "cat_idx", "metric_idx",
    )
    return folded.unionByName(single)
