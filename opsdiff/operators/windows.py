"""Time windows: parameters, checks, scans and window means."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsdiff.operators.chunks import HOUR, chunk_for, chunk_of, micros, sortable
from opsdiff.session import broadcast_if_small

MAX_WINDOW_DAYS = 32
SERIES = ["host", "metric", "instance"]


@dataclass(frozen=True)
class Windows:
    """Baseline window A, compared window B and the threshold in percent.

    Windows are half open, [start, end), so neighbours never share a sample.
    """

    a_start: datetime
    a_end: datetime
    b_start: datetime
    b_end: datetime
    threshold_pct: float = 15.0


def check_window(start: datetime, end: datetime, max_days: int | None = None) -> None:
    """Raises ValueError unless end is after start and the span is allowed."""
    if not end > start:
        raise ValueError("the end of a window must be after its start")
    if max_days is not None and end - start > timedelta(days=max_days):
        raise ValueError(f"a window must not be longer than {max_days} days")


def check_windows(windows: Windows, max_days: int | None = None) -> None:
    check_window(windows.a_start, windows.a_end, max_days)
    check_window(windows.b_start, windows.b_end, max_days)
    if not 0 <= windows.threshold_pct <= 10000:
        raise ValueError("the threshold must be between 0 and 10000")


def bad_windows(windows: DataFrame, max_days: int = MAX_WINDOW_DAYS) -> DataFrame:
    """Rows of a per-host window table that check_windows would reject, with the reason."""
    longest = F.expr(f"INTERVAL {max_days} DAYS")

    def reason(side: str) -> Column:
        start, end = F.col(f"{side}_start"), F.col(f"{side}_end")
        return (
            F.when(~F.coalesce(end > start, F.lit(False)), f"window {side}: end not after start")
            .when(end > start + longest, f"window {side}: longer than {max_days} days")
        )

    threshold = F.when(
        ~F.coalesce(F.col("threshold_pct").between(0, 10000), F.lit(False)),
        "threshold outside 0..10000",
    )
    return windows.withColumn("problem", F.coalesce(reason("a"), reason("b"), threshold)).where(
        F.col("problem").isNotNull()
    )


def checked_span(windows: DataFrame) -> tuple[datetime | None, datetime | None]:
    """From the first start to the last end of a per-host window table, (None, None) without rows.

    Raises ValueError if check_windows would reject a row.
    """
    def good(side: str) -> Column:
        return F.col(f"{side}_end") > F.col(f"{side}_start")

    bad = ~F.coalesce(good("a") & good("b") & F.col("threshold_pct").between(0, 10000), F.lit(False))
    row = windows.agg(
        F.min(F.least("a_start", "b_start")).alias("lo"), F.max(F.greatest("a_end", "b_end")).alias("hi"),
        F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col("host"))).alias("host"),
    ).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} hosts, {row['host']!r} among them, have a window that ends before it starts or a threshold outside 0..10000")
    return row["lo"], row["hi"]


def time_literal(df: DataFrame, column: str, value: datetime) -> Column:
    """A literal of the column's own timestamp type, so that the filter reaches the scan."""
    return F.lit(value.isoformat(sep=" ")).cast(df.schema[column].dataType)


def between(df: DataFrame, start: datetime, end: datetime, ts: str = "ts") -> Column:
    return (F.col(ts) >= time_literal(df, ts, start)) & (F.col(ts) < time_literal(df, ts, end))


def day_filter(df: DataFrame, start: datetime, end: datetime) -> Column:
    """Partition filter for tables laid out by ``date``."""
    if "date" not in df.columns:
        return F.lit(True)
    last = end - timedelta(microseconds=1)
    return F.col("date").between(F.lit(start.date()), F.lit(last.date()))


def scan_window(
    samples: DataFrame, start: datetime, end: datetime, metrics: list[str] | None = None
) -> DataFrame:
    """Samples in [start, end), of the given metrics when there is a list."""
    check_window(start, end)
    out = samples.where(day_filter(samples, start, end) & between(samples, start, end))
    return out if metrics is None else out.where(F.col("metric").isin(metrics))


def window_means(samples: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Mean of every series over [start, end): (host, metric, instance, val)."""
    return (
        scan_window(samples, start, end)
        .groupBy(*SERIES)
        .agg(F.avg("value").alias("val"))
        .where(F.col("val").isNotNull())
    )


def time_weighted_means(
    samples: DataFrame, start: datetime, end: datetime, chunk: timedelta | None = None
) -> DataFrame:
    """As window_means, but a value counts for the time until the next sample of its
    series (the last one until the end of the window)."""
    scanned = scan_window(samples, start, end).where(F.col("value").isNotNull())
    held = _steps(scanned, SERIES, chunk or chunk_for(end - start), _held_value)
    close = micros(F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"))
    stop = close + int((end - start).total_seconds() * 1e6)
    tail = stop - F.col("last.us")
    return held.select(
        *SERIES,
        F.try_divide(
            F.col("total") + F.col("last.value") * tail, F.col("span") + tail
        ).alias("val"),
    )


def _held_value(prev: Column, here: Column) -> tuple[Column, Column]:
    return prev["value"] * (here["us"] - prev["us"]), here["us"] - prev["us"]


def _counter_step(prev: Column, here: Column) -> tuple[Column, Column]:
    """Growth and time since the sample before; a falling counter was reset and gives neither."""
    grew = here["value"] >= prev["value"]
    return (
        F.when(grew, here["value"] - prev["value"]),
        F.when(grew, here["us"] - prev["us"]),
    )


def _segment(points: Column, step) -> Column:
    """struct(first, last, amount, span) of an array of samples struct(us, value) in any order.

    Walks from the last sample to the first, so that of samples with equal time the greatest value
    comes first and stands.
    """
    def plus(total: Column, x: Column) -> Column:
        return total + F.coalesce(x.cast("double"), F.lit(0.0))

    def walk(later: Column, here: Column) -> Column:
        amount, span = step(here, later["first"])
        return F.when(here["us"] == later["first"]["us"], later).otherwise(F.struct(
            here.alias("first"), later["last"].alias("last"),
            plus(later["amount"], amount).alias("amount"), plus(later["span"], span).alias("span"),
        ))

    def fold(sorted_: Column) -> Column:
        end = F.struct(
            sorted_[0].alias("first"), sorted_[0].alias("last"), F.lit(0.0).alias("amount"), F.lit(0.0).alias("span")
        )
        return F.aggregate(sorted_, end, walk)

    # A lambda's variable is computed once.
    return F.transform(F.array(F.sort_array(points, asc=False)), fold)[0]


def _steps(samples: DataFrame, keys: list[str], chunk: timedelta, step) -> DataFrame:
    """Sums a quantity over neighbouring samples: (keys, total, span, last).

    The samples of a series and chunk of time are gathered where they are read, copies once, and
    shuffled as one row a task; they become a segment (first, last, amount, span).  Segments are
    linked by one small row per chunk, so that a series with very many samples is spread over
    many tasks.
    """
    point = F.struct(micros(F.col("ts")).alias("us"), F.col("value").alias("value"))
    chunked = samples.select(*keys, chunk_of(F.col("ts"), chunk).alias("_chunk"), point.alias("p"))
    gathered = chunked.groupBy(*sortable([*keys, "_chunk"])).agg(F.collect_set("p").alias("points"))
    segments = gathered.select(*keys, "_chunk", _segment(F.col("points"), step).alias("s"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    amount, span = step(F.lag("s.last").over(across), F.col("s.first"))
    linked = segments.select(
        *keys, "s.amount", "s.span", "s.last", amount.alias("edge_amount"), span.alias("edge_span")
    )
    zero = F.lit(0.0)

    def total(a: str, b: str) -> Column:
        return F.sum(a) + F.coalesce(F.sum(b), zero)

    return linked.groupBy(*keys).agg(
        total("amount", "edge_amount").alias("total"),
        total("span", "edge_span").alias("span"),
        F.max("last").alias("last"),
    )


def counter_rates(
    samples: DataFrame, keys: list[str] = SERIES, chunk: timedelta = HOUR
) -> DataFrame:
    """Mean rate per second of cumulative counters: (keys, val), sum of growth by sum of time.

    Steps over which the counter falls (a reset) are left out of both sums.
    """
    present = samples.where(F.col("value").isNotNull())
    return (
        _steps(present, keys, chunk, _counter_step)
        .select(*keys, F.try_divide(F.col("total") * 1e6, F.col("span")).alias("val"))
        .where(F.col("val").isNotNull())
    )


def _paired_instants(samples: DataFrame, in_a: Column, in_b: Column, keys: list[str]) -> DataFrame:
    """Means of both windows in one pass over the samples.

    Units take part as a grouping key (a string aggregate would force sorting
    the samples); the few series with several units are merged afterwards.
    """
    has_units = "units" in samples.columns
    first = [*keys, "units"] if has_units else keys
    value = F.col("value")
    sums = samples.groupBy(*first).agg(
        F.sum(F.when(in_a, value)).alias("sum_a"),
        F.count(F.when(in_a, value)).alias("n_a"),
        F.sum(F.when(in_b, value)).alias("sum_b"),
        F.count(F.when(in_b, value)).alias("n_b"),
    )
    if has_units:
        # The unit seen in B stands, else the one seen in A.
        sums = sums.groupBy(*sortable(keys)).agg(
            F.sum("sum_a").alias("sum_a"), F.sum("n_a").alias("n_a"),
            F.sum("sum_b").alias("sum_b"), F.sum("n_b").alias("n_b"),
            F.max_by("units", F.struct(F.col("n_b") > 0, "n_b", "n_a", "units")).alias("units"),
        )
    else:
        sums = sums.withColumn("units", F.lit(""))
    return sums.select(
        *keys, "units",
        F.try_divide("sum_a", "n_a").alias("a"), F.try_divide("sum_b", "n_b").alias("b"),
    )


def _paired_counters(
    samples: DataFrame, in_a: Column, in_b: Column, keys: list[str], chunk: timedelta
) -> DataFrame:
    sides = F.filter(
        F.array(F.when(in_a, F.lit("a")), F.when(in_b, F.lit("b"))), lambda s: s.isNotNull()
    )
    units = ["units"] if "units" in samples.columns else []
    sided = samples.select(*keys, *units, "ts", "value", F.explode(sides).alias("side"))
    val, side = F.col("val"), F.col("side")
    rates = counter_rates(sided, [*keys, *units, "side"], chunk)
    unit = F.max_by("units", F.struct(side, "units")) if units else F.lit("")
    return rates.groupBy(*keys).agg(
        unit.alias("units"),
        F.avg(F.when(side == "a", val)).alias("a"),
        F.avg(F.when(side == "b", val)).alias("b"),
    )


def paired_means(
    samples: DataFrame, windows: Windows | DataFrame, metrics: list[str] | None = None
) -> DataFrame:
    """Means of windows A and B side by side: (host, metric, instance, units, threshold_pct, a, b).

    ``windows`` is one pair for all hosts, or a table with one pair per host
    (host, a_start, a_end, b_start, b_end, threshold_pct).  When the samples
    have a column ``kind``, series of kind 'counter' are averaged as rates.
    A series without any value in a window has NULL there.
    """
    if metrics is not None:
        samples = samples.where(F.col("metric").isin(metrics))
    if isinstance(windows, DataFrame):
        # The span of all windows cuts the scan, day folders included; the few rows per host
        # meet the samples by broadcast, or by a shuffle when there are very many hosts.
        ts = F.col("ts")
        lo, hi = checked_span(windows)
        inside = day_filter(samples, lo, hi) & between(samples, lo, hi) if lo else F.lit(False)
        scanned = samples.where(inside).join(broadcast_if_small(windows), "host")
        in_a = (ts >= F.col("a_start")) & (ts < F.col("a_end"))
        in_b = (ts >= F.col("b_start")) & (ts < F.col("b_end"))
        keys, chunk = [*SERIES, "threshold_pct"], HOUR
    else:
        check_windows(windows)
        in_a = between(samples, windows.a_start, windows.a_end)
        in_b = between(samples, windows.b_start, windows.b_end)
        scanned = samples.where(
            day_filter(samples, windows.a_start, windows.a_end)
            | day_filter(samples, windows.b_start, windows.b_end)
        )
        keys = SERIES
        chunk = chunk_for(max(windows.a_end - windows.a_start, windows.b_end - windows.b_start))
    scanned = scanned.where(in_a | in_b)
    if "kind" in samples.columns:
        is_counter = F.coalesce(F.col("kind") == "counter", F.lit(False))
        means = _paired_instants(scanned.where(~is_counter), in_a, in_b, keys).unionByName(
            _paired_counters(scanned.where(is_counter), in_a, in_b, keys, chunk)
        )
    else:
        means = _paired_instants(scanned, in_a, in_b, keys)
    if keys is SERIES:
        means = means.withColumn("threshold_pct", F.lit(float(windows.threshold_pct)))
    return means.where(F.col("a").isNotNull() | F.col("b").isNotNull())


# ---- anchored windows ------------------------------------------------------

DIFF_PRESETS = ["yesterday", "previous_hour", "today"]


def window_columns(preset: str, now: Column) -> list[Column]:
    """a_start, a_end, b_start, b_end of an anchored preset, relative to ``now``.

    yesterday: the last full hour against the same hour a day earlier;
    previous_hour: the last full hour against the hour before;
    today: today so far against the whole of yesterday.
    """
    hour, day = F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 DAY")
    full = F.date_trunc("hour", now).cast("timestamp_ntz")
    midnight = F.date_trunc("day", now).cast("timestamp_ntz")
    if preset == "yesterday":
        cols = [full - hour - day, full - day, full - hour, full]
    elif preset == "previous_hour":
        cols = [full - hour - hour, full - hour, full - hour, full]
    elif preset == "today":
        cols = [midnight - day, midnight, midnight, now]
    else:
        raise ValueError(f"unknown window preset: {preset!r}")
    return [c.alias(n) for c, n in zip(cols, ["a_start", "a_end", "b_start", "b_end"])]


def windows_for(preset: str, now: datetime, threshold_pct: float = 15.0) -> Windows:
    """Scalar form of window_columns."""
    full = now.replace(minute=0, second=0, microsecond=0)
    midnight = full.replace(hour=0)
    hour, day = timedelta(hours=1), timedelta(days=1)
    spans = {
        "yesterday": (full - hour - day, full - day, full - hour, full),
        "previous_hour": (full - 2 * hour, full - hour, full - hour, full),
        "today": (midnight - day, midnight, midnight, now),
    }
    if preset not in spans:
        raise ValueError(f"unknown window preset: {preset!r}")
    return Windows(*spans[preset], threshold_pct)


def last_hours(hours: int, now: datetime) -> tuple[datetime, datetime]:
    """The trend range that ends now."""
    return now - timedelta(hours=hours), now
