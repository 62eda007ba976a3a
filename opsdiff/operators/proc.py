"""Process accounting: processor time and memory by command name, and restarts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdiff.functions.judge import PROC_KINDS, display_weight, judge_proc, rank_in, restarted
from opsdiff.functions.text import ago_text, proc_name
from opsdiff.operators.windows import Windows, paired_means
from opsdiff.sources.fixed_values import PROC_CPU_METRICS, PROC_RSS_METRIC, PROC_START_METRIC

PROC_METRICS = [*PROC_CPU_METRICS, PROC_RSS_METRIC, PROC_START_METRIC]
DEFAULT_THRESHOLD = 20.0


def _by_name(means: DataFrame, sides: dict[str, str]) -> DataFrame:
    """Per (host, name) and side: number of values, cpu, rss and start time.

    cpu is the sum of user and system time over all processes of the name, rss
    and start time are maxima from 0 up; an absent part is 0, not NULL.
    """
    metric = F.col("metric")
    aggregates = []
    for side, column in sides.items():
        value = F.col(column)

        def top(name: str) -> Column:
            # greatest() skips NULL, so a name without the metric has 0.
            return F.greatest(F.max(F.when(metric == name, value)), F.lit(0.0))

        aggregates += [
            F.count(value).alias(f"n{side}"),
            F.coalesce(
                F.sum(F.when(metric.isin(PROC_CPU_METRICS), value)), F.lit(0.0)
            ).alias(f"cpu{side}"),
            top(PROC_RSS_METRIC).alias(f"rss{side}"),
            top(PROC_START_METRIC).alias(f"start{side}"),
        ]
    # Nameless instances are dropped as one group, not tested row by row.
    named = means.groupBy("host", proc_name(F.col("instance")).alias("name")).agg(*aggregates)
    return named.where(F.col("name") != "")


def proc_samples(means: DataFrame) -> DataFrame:
    """Processes of one window: (host, name, cpu_ms, rss, start_time, n) from window means."""
    return _by_name(means.where(F.col("metric").isin(PROC_METRICS)), {"": "val"}).select(
        "host", "name", F.col("cpu").alias("cpu_ms"), "rss",
        F.col("start").alias("start_time"), "n",
    )


def proc_diff(samples: DataFrame, windows: Windows | DataFrame) -> DataFrame:
    """Two rows (cpu and mem) per host and command name, judged against each other.

    The two measures come out of one grouping and one explode; a name that only
    one window has is NULL on the other side and counts as appeared or gone.
    """
    means = paired_means(samples, windows, PROC_METRICS)
    named = _by_name(means, {"_a": "a", "_b": "b"})
    if isinstance(windows, DataFrame):
        named = named.join(windows.select("host", "threshold_pct"), "host")
    else:
        named = named.withColumn("threshold_pct", F.lit(float(windows.threshold_pct)))
    has_a, has_b = F.col("n_a") > 0, F.col("n_b") > 0

    def measure(name: str, column: str, unit: str) -> Column:
        return F.struct(
            F.lit(name).alias("metric"),
            F.when(has_a, F.col(f"{column}_a")).alias("a"),
            F.when(has_b, F.col(f"{column}_b")).alias("b"),
            F.lit(unit).alias("unit"),
        )

    start_a = F.when(has_a, F.col("start_a")).otherwise(0.0)
    start_b = F.when(has_b, F.col("start_b")).otherwise(0.0)
    rows = named.select(
        "host", "name", "threshold_pct",
        (has_a & has_b & restarted(start_a, start_b)).alias("restarted"),
        start_a.alias("start_a"), start_b.alias("start_b"),
        F.inline(F.array(measure("cpu", "cpu", "ms/s"), measure("mem", "rss", "KB"))),
    )
    verdict = judge_proc(F.col("a"), F.col("b"), F.col("threshold_pct"))
    return rows.withColumn("j", verdict).select(
        "host", "name", "metric", "a", "b", "j.delta_pct", "j.verdict", "restarted",
        "start_a", "start_b", "unit",
        rank_in(F.col("j.verdict"), PROC_KINDS).alias("verdict_rank"),
        display_weight(F.col("j.delta_pct"), F.col("a"), F.col("b")).alias("weight"),
    )


def in_proc_order(rows: DataFrame) -> DataFrame:
    """Sorted for output: by measure, then worst verdict, greatest change, name."""
    return rows.orderBy("host", "metric", "verdict_rank", F.desc("weight"), "name")


def restarts(rows: DataFrame) -> DataFrame:
    """One row per restarted process."""
    return rows.where((F.col("metric") == "cpu") & F.col("restarted")).select(
        "host", "name", "start_a", "start_b"
    )


def restart_text(start_a: Column, start_b: Column, now_ms: Column) -> Column:
    return F.concat(ago_text(now_ms - start_a), F.lit(" → "), ago_text(now_ms - start_b))


def hosts_without_data(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Hosts for which the process report has no rows at all."""
    return hosts.select("host").join(rows.select("host").distinct(), "host", "left_anti")
