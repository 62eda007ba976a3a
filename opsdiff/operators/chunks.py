"""Order-dependent steps over long series without one task per series.

A plain ``lag`` or running window keeps a whole series in one task.  These
helpers cut the time axis into chunks: the order-dependent work runs per
(series, chunk), and only one small row per chunk takes part in the step that
links neighbouring chunks.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsdiff.session import fetched_if_small

HOUR = timedelta(hours=1)
DAY = timedelta(days=1)


def sortable(keys: list[str]) -> list:
    """Grouping columns with a hash of them in front.

    Aggregates of strings and structs sort their input; a number in front
    decides nearly every comparison, where long common prefixes would not.
    """
    return [F.xxhash64(*keys).alias("_order"), *keys]


def chunk_for(span: timedelta) -> timedelta:
    """Chunk of a time span: a thousandth, so that a series that holds a third of all rows
    is cut into a thousand pieces, but not below a minute."""
    return max(span / 1000, timedelta(minutes=1))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for TIMESTAMP and TIMESTAMP_NTZ alike."""
    return F.unix_micros(ts.cast("timestamp"))


def chunk_of(ts: Column, size: timedelta) -> Column:
    return F.floor(micros(ts) / int(size.total_seconds() * 1e6)).cast("bigint")


def with_previous(
    df: DataFrame, keys: list[str], ts: str, value: str, out: str, chunk: timedelta
) -> DataFrame:
    """Adds ``out``: the ``value`` of the row before, per series, NULL on the first row.

    (keys, ts) has to be unique.  Rows are shuffled once by (keys, chunk); the
    last value of every chunk is carried over to the first row of the next one.
    """
    chunked = df.withColumn("_chunk", chunk_of(F.col(ts), chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(ts)
    stepped = chunked.withColumns({
        "_inner": F.lag(F.struct(value)).over(inside),
        "_first": F.row_number().over(inside) == 1,
    })
    edges = chunked.groupBy(*keys, "_chunk").agg(F.max_by(value, ts).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_chunk")
    carried = edges.select(
        *keys, "_chunk", F.lag("_last").over(before).alias("_carried")
    )
    return stepped.join(carried, [*keys, "_chunk"], "left").select(
        *df.columns,
        F.when(F.col("_first"), F.col("_carried"))
        .otherwise(F.col("_inner")[value])
        .alias(out),
    )


DEPTH = 1 << 17


def latest_at_or_before(
    anchors: DataFrame, times: DataFrame, key: str, anchor: str, ts: str, out: str,
    chunk: timedelta = DAY, depth: int = DEPTH,
) -> DataFrame:
    """Adds ``out`` to every anchor: the greatest ``ts`` of its key that is not later.

    An as-of join on time alone, by a running maximum on two levels: over the chunks of a key, one
    small row each, and inside a chunk, which starts with what the chunks before it had.  Anchors
    are counted per chunk first; a chunk deeper than ``depth`` is split into as many shares, and
    the (fewer, distinct) times of that chunk are copied to each.  So no task grows with a
    busy key, a busy hour or copies of a row, and the anchors are shuffled once.
    """
    seen = F.col(ts)
    distinct = times.select(key, ts).distinct()
    counts = anchors.groupBy(key, chunk_of(F.col(anchor), chunk).alias("_chunk")).agg(F.count("*").alias("_n"))
    # At most one chunk for each ``depth`` anchors.
    deep = fetched_if_small(
        counts.where(F.col("_n") > depth).select(key, "_chunk", F.ceil(F.col("_n") / depth).cast("int").alias("_shares"))
    )
    tops = distinct.groupBy(key, chunk_of(seen, chunk).alias("_chunk")).agg(F.max(ts).alias("_top"))
    asked = counts.select(key, "_chunk", F.lit(None).cast(times.schema[ts].dataType).alias("_top"))
    edges = tops.unionByName(asked).groupBy(key, "_chunk").agg(F.max("_top").alias("_top"))
    earlier = (
        Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = edges.select(key, "_chunk", F.max("_top").over(earlier).alias("_seen")).where("_seen is not null")

    asks = anchors.select(
        F.col(key), chunk_of(F.col(anchor), chunk).alias("_chunk"), F.col(anchor).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(times.schema[ts].dataType).alias("_seen"), F.struct(*anchors.columns).alias("_row"),
    )
    # A time without a moment of its own comes before all others of its chunk.
    marks = distinct.select(key, chunk_of(seen, chunk).alias("_chunk"), seen.alias("_at"), seen.alias("_seen")).unionByName(
        carried.select(key, "_chunk", F.lit(None).cast(times.schema[ts].dataType).alias("_at"), "_seen")
    ).select(
        key, "_chunk", F.col("_at").cast(asks.schema["_at"].dataType).alias("_at"), F.lit(0).alias("_side"), "_seen",
        F.lit(None).cast(asks.schema["_row"].dataType).alias("_row"),
    )
    shares = F.coalesce("_shares", F.lit(1))
    # The task's number spreads copies of one row.
    share = F.pmod(F.xxhash64("_row", F.spark_partition_id()), shares).cast("int")
    columns = [key, "_chunk", "_at", "_side", "_seen", "_row"]
    salted = asks.join(deep, [key, "_chunk"], "left").select(*columns, share.alias("_salt")).unionByName(
        marks.join(deep, [key, "_chunk"], "left").select(*columns, F.explode(F.sequence(F.lit(0), shares - 1)).alias("_salt"))
    )
    running = (
        Window.partitionBy(key, "_chunk", "_salt")
        .orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = salted.withColumn(out, F.max("_seen").over(running)).where("_side = 1")
    return inside.select("_row.*", out)
