"""Trends: samples resampled to a regular step, gaps, overlay of a day earlier."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsdiff.operators.dedupe import missing_metrics
from opsdiff.operators.ordinals import with_ordinal
from opsdiff.operators.windows import (
    SERIES, between, check_window, day_filter, scan_window, time_literal,
)
from opsdiff.sources.catalog import short_list

POINTS = 600
MIN_STEP = timedelta(seconds=10)
MAX_STEP = timedelta(minutes=15)
DAY = timedelta(days=1)


def trend_step(start: datetime, end: datetime) -> timedelta:
    """Step of about 600 points per series, between 10 s and 15 min, in whole seconds."""
    step = (end - start) / POINTS
    if step < MIN_STEP:
        return MIN_STEP
    if step > MAX_STEP:
        return MAX_STEP
    return timedelta(seconds=int(step.total_seconds() + 0.5))


def trend_step_seconds(start: Column, end: Column) -> Column:
    """Column form of trend_step, in seconds."""
    span = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    step = span / POINTS
    low, high = MIN_STEP.total_seconds(), MAX_STEP.total_seconds()
    return F.least(F.greatest(F.round(step), F.lit(low)), F.lit(high)).cast("bigint")


def series_name() -> Column:
    """``metric-instance``, or the metric alone when it has no instances."""
    return F.when(F.col("instance") == "", F.col("metric")).otherwise(
        F.concat_ws("-", "metric", "instance")
    )


def _in_group(samples: DataFrame, metrics: list[str] | DataFrame) -> DataFrame:
    """Samples of the metrics of a group.

    A list, or a table of a few names such as a preset, becomes a filter that
    reaches the scan; a longer table is joined.
    """
    if isinstance(metrics, DataFrame):
        names = short_list(metrics)
        if names is None:
            return samples.join(metrics.select("metric"), "metric", "left_semi")
        metrics = names
    return samples.where(F.col("metric").isin(metrics))


def _bucket(ts: Column, start: datetime, step: timedelta) -> Column:
    """Start of the step a moment falls into; steps are aligned to the window, not the epoch."""
    size = int(step.total_seconds())
    epoch = datetime(1970, 1, 1)
    offset = (start - epoch) % step
    return F.window(
        ts, f"{size} seconds", startTime=f"{int(offset / timedelta(microseconds=1))} microseconds"
    )["start"]


def _resampled(how: str, value: Column, ts: Column) -> Column:
    if how == "avg":
        return F.avg(value)
    if how == "last":
        return F.max_by(value, F.when(value.isNotNull(), ts))
    raise ValueError(f"unknown resampling: {how!r}")


def trend(
    samples: DataFrame, metrics: list[str] | DataFrame, start: datetime, end: datetime,
    step: timedelta | None = None, how: str = "avg",
) -> DataFrame:
    """One value per series and step in [start, end): (host, metric, instance, bucket, value).

    ``metrics`` is a list of names or a table of them such as a preset.  ``how``
    is the mean of the samples of a step, or the last one.
    """
    check_window(start, end)
    step = step or trend_step(start, end)
    scanned = _in_group(scan_window(samples, start, end), metrics)
    return scanned.groupBy(*SERIES, _bucket(F.col("ts"), start, step).alias("bucket")).agg(
        _resampled(how, F.col("value"), F.col("ts")).alias("value")
    )


def fill_grid(
    points: DataFrame, start: datetime, end: datetime, step: timedelta
) -> DataFrame:
    """Adds a NULL point for every step a series has no value in, so that gaps stay gaps.

    Every point also yields the empty steps up to the next point of its series,
    and the first one those since ``start``: the points are read once, and a
    series has no more rows than the window has steps.
    """
    series = Window.partitionBy(*SERIES).orderBy("bucket")
    bucket = F.col("bucket")
    by = F.make_dt_interval(secs=F.lit(step.total_seconds()))
    tick = F.make_dt_interval(secs=F.lit(1e-6))
    first = F.when(F.lag("bucket").over(series).isNull(), time_literal(points, "bucket", start))
    until = F.coalesce(F.lead("bucket").over(series), time_literal(points, "bucket", end))
    spans = points.select(
        *SERIES, "bucket", "value", F.coalesce(first, bucket).alias("_from"), until.alias("_until")
    )
    return spans.select(
        *SERIES, bucket.alias("_own"), "value",
        F.explode(F.sequence(F.col("_from"), F.col("_until") - tick, by)).alias("bucket"),
    ).select(*SERIES, "bucket", F.when(F.col("bucket") == F.col("_own"), F.col("value")).alias("value"))


def overlay(
    samples: DataFrame, metrics: list[str] | DataFrame, start: datetime, end: datetime,
    shift: timedelta = DAY, step: timedelta | None = None, how: str = "avg",
) -> DataFrame:
    """The trend with the window ``shift`` earlier laid over it: (..., bucket, value, earlier).

    The earlier samples are moved forward and meet today's in one grouping, so
    the table is read and shuffled once, without a self join.  Points that only
    one of the two days has keep NULL on the other side.
    """
    check_window(start, end)
    step = step or trend_step(start, end)
    ts = F.col("ts")
    now, before = between(samples, start, end), between(samples, start - shift, end - shift)
    scanned = samples.where(
        day_filter(samples, start, end) | day_filter(samples, start - shift, end - shift)
    ).where(now | before)
    moved = ts + F.make_dt_interval(secs=F.lit(shift.total_seconds()))
    sides = F.filter(
        F.array(
            F.when(now, F.struct(ts.alias("at"), F.lit(True).alias("today"))),
            F.when(before, F.struct(moved.alias("at"), F.lit(False).alias("today"))),
        ),
        lambda s: s.isNotNull(),
    )
    sided = _in_group(scanned, metrics).select(*SERIES, "value", F.inline(sides))
    value, at = F.col("value"), F.col("at")
    return sided.groupBy(*SERIES, _bucket(at, start, step).alias("bucket")).agg(
        _resampled(how, F.when(F.col("today"), value), at).alias("value"),
        _resampled(how, F.when(~F.col("today"), value), at).alias("earlier"),
    )


def trend_wide(points: DataFrame, series: list[str]) -> DataFrame:
    """One column per series named in ``series``, one row per host and step.

    A series has one value per step, so a plain conditional maximum picks it in
    a single grouping.
    """
    named = points.withColumn("series", series_name())
    return named.groupBy("host", "bucket").agg(
        *[F.max(F.when(F.col("series") == s, F.col("value"))).alias(s) for s in series]
    )


def as_series(points: DataFrame) -> DataFrame:
    """(host, series, points) with points [(ms, v), ...] in time order.

    A resampled series has a bounded number of steps (at most 3,072 for the
    longest window), so collecting them stays small.
    """
    point = F.struct(
        F.unix_millis(F.col("bucket").cast("timestamp")).alias("ms"), F.col("value").alias("v")
    )
    return points.groupBy("host", series_name().alias("series")).agg(
        F.sort_array(F.collect_list(point)).alias("points")
    )


def in_series_order(points: DataFrame) -> DataFrame:
    return points.orderBy(*SERIES, "bucket")


def numbered_points(points: DataFrame, path: str | None = None) -> DataFrame:
    """Points with ``n``, their place among those of the host in series and time order."""
    return with_ordinal(points, [*SERIES[1:], "bucket"], "n", within=SERIES[0], path=path)


def trend_missing(
    samples: DataFrame, wanted: DataFrame, start: datetime, end: datetime,
    hosts: DataFrame | None = None,
) -> DataFrame:
    """Metrics of the group that a host has no sample of in the window."""
    return missing_metrics(scan_window(samples, start, end), wanted, hosts)


def require_any(samples: DataFrame, wanted: DataFrame, start: datetime, end: datetime) -> None:
    """Raises ValueError when no metric of the group was recorded in the window at all."""
    if not _in_group(scan_window(samples, start, end), wanted).limit(1).count():
        raise ValueError("none of the metrics of this group were recorded in the window")
