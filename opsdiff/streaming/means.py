"""Streaming window means, and the watch of closed windows against a baseline."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from opsdiff.operators.diff import focus, judge_means
from opsdiff.operators.rules import findings
from opsdiff.operators.windows import SERIES
from opsdiff.session import rocksdb_state
from opsdiff.sources.catalog import Catalog
from opsdiff.sources.rules import Rules


def streaming_means(
    samples: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Means per series and window: (host, metric, instance, start, end, val).

    Tumbling windows, or sliding ones with ``slide``.  A window is emitted once,
    when the watermark has passed its end; samples later than that are dropped.
    The grouping has a map-side step, so a busy series is reduced where it is read.
    """
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        samples.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(window.alias("w"), *SERIES)
        .agg(F.avg("value").alias("val"))
        .select(*SERIES, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "val")
    )


TIERS = ("10 seconds", "60 seconds", "5 minutes")
SUMS = "host string, metric string, instance string, start timestamp, end timestamp, total double, n long"


def _sums(rows: DataFrame, at: str, size: str, total: Column, n: Column) -> DataFrame:
    grouped = rows.groupBy(F.window(at, size).alias("w"), *SERIES).agg(total.alias("total"), n.alias("n"))
    return grouped.where("n > 0").select(
        *SERIES, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n"
    )


def tier_sums(samples: DataFrame, size: str = TIERS[0], late: str = "10 minutes") -> DataFrame:
    """Closed windows of the finest tier as sums that can be added up: SUMS."""
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return _sums(timed, "ts", size, F.sum("value"), F.count("value"))


def rolled_up(sums: DataFrame, size: str) -> DataFrame:
    """Closed windows of the next tier, from those of a finer one, whose size divides this one.

    A finer tier delivers its windows in the order of its watermark, so that nothing is late here: a
    window closes as soon as a finer one starts at its end or after it.
    """
    return _sums(sums.withWatermark("start", "0 seconds"), "start", size, F.sum("total"), F.sum("n"))


def tier_means(spark: SparkSession, out: str, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """What the tiers have delivered: (tier, host, metric, instance, start, end, val)."""
    parts = [
        spark.read.schema(SUMS).parquet(_tier_path(out, tier)).select(
            F.lit(tier).alias("tier"), *SERIES, "start", "end", F.try_divide("total", "n").alias("val")
        )
        for tier in tiers
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _tier_path(out: str, tier: str) -> str:
    return f"{out.rstrip('/')}/{tier.replace(' ', '-')}"


def start_tiers(
    samples: DataFrame, out: str, checkpoint: str, tiers: tuple[str, ...] = TIERS,
    late: str = "10 minutes", trigger: dict | None = None,
) -> list[StreamingQuery]:
    """Keeps means of several tiers, each made from the sums of the tier before.

    Only the finest tier reads the samples.  Every tier is a table of sums (SUMS) below ``out`` that
    the next one streams from, with a checkpoint of its own: a tier that fails goes on where
    it stopped, and one more tier can be added later.  With the trigger availableNow the tiers run
    one after another over what is there.
    """
    spark, trigger = samples.sparkSession, trigger or {"processingTime": "10 seconds"}
    queries, stream = [], tier_sums(samples, tiers[0], late)
    for k, tier in enumerate(tiers):
        path = _tier_path(out, tier)
        if k:
            finer = _tier_path(out, tiers[k - 1])
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(finer)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
            stream = rolled_up(spark.readStream.schema(SUMS).parquet(finer), tier)
        with rocksdb_state(spark):
            query = (
                stream.writeStream.format("parquet").outputMode("append")
                .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{k}")
                .trigger(**trigger).start(path)
            )
        if trigger.get("availableNow"):
            query.awaitTermination()
        queries.append(query)
    return queries


def judge_window(
    closed: DataFrame, baseline: DataFrame, catalog: Catalog, threshold_pct: float
) -> DataFrame:
    """Rows of closed B windows against the baseline means (host, metric, instance, val).

    The window is part of the host key, so each one is judged on its own.  A
    baseline series without a value in a window is reported as gone for every
    window in which its host delivered anything.
    """
    windows = closed.select("host", "start", "end").distinct()
    b = closed.select(*SERIES, "start", "end", F.col("val").alias("b"), F.lit(None).cast("double").alias("a"))
    a = baseline.select(*SERIES, F.col("val").alias("a")).join(windows, "host").select(
        *SERIES, "start", "end", F.lit(None).cast("double").alias("b"), "a"
    )
    paired = (
        b.unionByName(a)
        .groupBy(*SERIES, "start", "end")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    # judge_means keeps the columns of a row; host carries the window through it.
    keyed = paired.select(
        F.struct("host", "start", "end").alias("host"), "metric", "instance",
        F.lit("").alias("units"), F.lit(float(threshold_pct)).alias("threshold_pct"), "a", "b",
    )
    return judge_means(keyed, catalog)


def _unkey(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "host"]
    return df.select("host.host", "host.start", "host.end", *rest)


def watch(
    samples: DataFrame, baseline: DataFrame, catalog: Catalog, rules: Rules,
    out: str, checkpoint: str, size: str, late: str = "10 minutes",
    threshold_pct: float = 15.0, trigger: dict | None = None,
) -> StreamingQuery:
    """Judges every closed window against a static baseline and diagnoses it.

    Writes changed rows to ``out/rows`` and findings to ``out/findings``, one
    folder per micro-batch: a batch that is run again after a failure replaces
    its own output.  The baseline is written to ``out/baseline`` at the start, so
    that no batch computes it again.
    """
    baseline.write.mode("overwrite").parquet(f"{out}/baseline")
    kept = baseline.sparkSession.read.schema(baseline.schema).parquet(f"{out}/baseline")

    def handle(closed: DataFrame, batch_id: int) -> None:
        closed = closed.persist()  # used for the windows and for their means
        rows = judge_window(closed, kept, catalog, threshold_pct).persist()
        try:
            _unkey(focus(rows)).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
            _unkey(findings(rows, rules)).write.mode("overwrite").parquet(
                f"{out}/findings/batch={batch_id}"
            )
        finally:
            rows.unpersist()
            closed.unpersist()

    return (
        streaming_means(samples, size, late=late)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def run_available(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs an append stream over what is there, into parquet, and reads that back."""
    spark: SparkSession = df.sparkSession
    with rocksdb_state(spark):
        query = (
            df.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(out)
        )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


FACT_KEY = ["host", "taken", "section", "key"]


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.Table.from_batches([batch]).append_column("row", pa.array(range(batch.num_rows)))
        first = rows.group_by(FACT_KEY, use_threads=False).aggregate([("row", "min")])
        yield from rows.take(first["row_min"]).drop_columns("row").to_batches()


def deduplicated(facts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Facts of a stream, each delivered once: repeats inside the watermark are dropped.

    Copies next to each other are dropped where they are read, so that a fact
    delivered very often does not load the one task that keeps its state.
    """
    timed = facts.withColumn("taken", F.col("taken").cast("timestamp"))
    return (
        timed.mapInArrow(_first_of_batch, timed.schema)
        .withWatermark("taken", late)
        .dropDuplicatesWithinWatermark(FACT_KEY)
    )
