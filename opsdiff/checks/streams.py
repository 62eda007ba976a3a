"""Checks of the streaming operators: the tables are streamed to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsdiff.checks import inputs as i
from opsdiff.checks.base import check, rounded
from opsdiff.checks.inputs import state_diff_sql
from opsdiff.operators import windows
from opsdiff.session import shared_dir
from opsdiff.sources.catalog import builtin_catalog
from opsdiff.sources.rules import builtin_rules
from opsdiff.streaming import feeds, means

# A window is closed when the watermark, the greatest time less the delay, has passed it.
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run(spark, df, name):
    return means.run_available(df, shared_dir(spark, name), shared_dir(spark, name + "-state"))


@check("stream_means", f"""WITH {i.SAMPLES}, w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start FROM samples)
SELECT host, metric, instance, start, start + INTERVAL 6 HOUR AS "end", round(avg(value) + 3e-8, 4) AS val FROM w
WHERE start + INTERVAL 6 HOUR <= {_CLOSED} GROUP BY ALL""")
def stream_means(spark, sf_dir):
    stream = means.streaming_means(i.samples_of(event_stream(spark, sf_dir)), "6 hours")
    return _plain_times(rounded(run(spark, stream, "means"), "val"), "start", "end")


def _plain_times(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@check("stream_sliding_means", f"""WITH {i.SAMPLES}, w AS (SELECT s.*, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') - k * INTERVAL 12 HOUR AS start
  FROM samples s CROSS JOIN (VALUES (0), (1)) t(k))
SELECT host, metric, instance, start, start + INTERVAL 1 DAY AS "end", round(avg(value) + 3e-8, 4) AS val FROM w
WHERE start + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL""")
def stream_sliding_means(spark, sf_dir):
    stream = means.streaming_means(i.samples_of(event_stream(spark, sf_dir)), "1 day", "12 hours")
    return _plain_times(rounded(run(spark, stream, "sliding"), "val"), "start", "end")


_TIER_1 = "(SELECT max(time_bucket(INTERVAL 10 SECOND, ts)) FROM events WHERE time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL 10 SECOND <= " + _CLOSED + ")"
_TIER_2 = f"(SELECT max(time_bucket(INTERVAL 60 SECOND, ts)) FROM events WHERE time_bucket(INTERVAL 60 SECOND, ts) + INTERVAL 60 SECOND <= {_TIER_1})"


@check("stream_tiers", f"WITH {i.SAMPLES} " + " UNION ALL ".join(
    f"""SELECT '{tier}' AS tier, host, metric, instance, time_bucket(INTERVAL {tier}, ts) AS start, time_bucket(INTERVAL {tier}, ts) + INTERVAL {tier} AS "end",
  round(avg(value) + 3e-8, 4) AS val FROM samples WHERE time_bucket(INTERVAL {tier}, ts) + INTERVAL {tier} <= {closed} GROUP BY ALL"""
    for tier, closed in zip(means.TIERS, (_CLOSED, _TIER_1, _TIER_2))
))
def stream_tiers(spark, sf_dir):
    out = shared_dir(spark, "tiers")
    means.start_tiers(i.samples_of(event_stream(spark, sf_dir)), out, shared_dir(spark, "tiers-state"), trigger={"availableNow": True})
    return _plain_times(rounded(means.tier_means(spark, out), "val"), "start", "end")


@check("stream_watch", f"""WITH {i.SAMPLES}, {i.CATALOG},
base AS (SELECT host, metric, instance, avg(value) AS val FROM samples WHERE ts < {i.sql_ts(i.HALVES.a_end)} GROUP BY ALL),
closed AS (SELECT host, metric, instance, time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '2024-01-03') AS start, avg(value) AS val FROM samples GROUP BY ALL),
done AS (SELECT * FROM closed WHERE start + INTERVAL 5 DAY <= {_CLOSED}),
means AS (SELECT coalesce(d.host, x.host) AS host, coalesce(d.metric, x.metric) AS metric, coalesce(d.instance, x.instance) AS instance,
    coalesce(d.start, x.start) AS start, '' AS units, x.val AS a, d.val AS b FROM done d FULL OUTER JOIN
    (SELECT b.*, w.start FROM base b JOIN (SELECT DISTINCT host, start FROM done) w ON b.host = w.host) x
    ON d.host = x.host AND d.metric = x.metric AND d.instance = x.instance AND d.start = x.start), {i.ROWS}
SELECT host, start, start + INTERVAL 5 DAY AS "end", metric, instance, kind, round(a + 3e-8, 4) AS a, round(b + 3e-8, 4) AS b, round(delta_pct + 3e-8, 4) AS delta_pct
FROM rows_ WHERE kind <> 'flat'""")
def stream_watch(spark, sf_dir):
    rows = spark.read.parquet(f"{_watched(spark, sf_dir)}/rows").select(
        "host", "start", "end", "metric", "instance", "kind", "a", "b", "delta_pct"
    )
    return _plain_times(rounded(rows, "a", "b", "delta_pct"), "start", "end")


def _watched(spark, sf_dir):
    out = shared_dir(spark, "watch")
    baseline = windows.window_means(i.samples(spark, sf_dir), i.HALVES.a_start, i.HALVES.a_end)
    query = means.watch(
        i.samples_of(event_stream(spark, sf_dir)), baseline, builtin_catalog(spark),
        builtin_rules(spark), out, shared_dir(spark, "watch-state"), "5 days",
        trigger={"availableNow": True},
    )
    query.awaitTermination()
    return out


def daily_snapshots(spark, sf_dir):
    """(host, taken, sections) per host and day, written so that days arrive as files in order."""
    facts = i.facts(spark, sf_dir)
    last = facts.groupBy("host", "taken", "section", "key").agg(
        F.max(F.struct("seq", "value")).alias("f")
    )
    sections = last.groupBy("host", "taken", "section").agg(
        F.collect_list(F.struct("key", F.col("f.value").alias("value"), F.lit("").alias("note"))).alias("items")
    )
    return sections.groupBy("host", "taken").agg(
        F.collect_list(F.struct(F.col("section").alias("name"), "items")).alias("sections")
    ).withColumn("taken", F.col("taken").cast("timestamp"))


_SECTION_CHANGES = state_diff_sql(*[
    f"SELECT p.a_taken, p.b_taken, f.* EXCLUDE (taken) FROM facts f JOIN pairs p "
    f"ON f.host = p.host AND f.section = p.section AND f.taken = p.{side}_taken" for side in "ab"
], "host, a_taken, b_taken")


@check("stream_changes", f"""WITH {i.FACTS}, pairs AS (SELECT * FROM (
  SELECT host, section, lag(taken) OVER (PARTITION BY host, section ORDER BY taken) AS a_taken, taken AS b_taken
  FROM (SELECT DISTINCT host, section, taken FROM facts)) WHERE a_taken IS NOT NULL), {_SECTION_CHANGES}
SELECT host, section, b_taken AS taken, key, kind, old, new FROM changes""")
def stream_changes(spark, sf_dir):
    path = shared_dir(spark, "snapshots")
    daily_snapshots(spark, sf_dir).write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path)
    return _plain_times(run(spark, feeds.change_feed(stream, salts=4), "changes"), "taken")


@check("stream_restarts", """WITH s AS (SELECT DISTINCT 'u' || user_id AS host, event_type AS name, epoch_ms(date_trunc('hour', ts))::DOUBLE AS start FROM events),
p AS (SELECT host, name, lag(start) OVER (PARTITION BY host, name ORDER BY start) AS start_before, start AS start_now FROM s)
SELECT * FROM p WHERE start_before IS NOT NULL AND start_now - start_before > 60000""")
def stream_restarts(spark, sf_dir):
    processes = event_stream(spark, sf_dir).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"),
        F.col("event_type").alias("name"),
        F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).cast("double").alias("start_time"), "ts",
    )
    return run(spark, feeds.restart_feed(processes), "restarts")


@check("stream_deduplicated", f"WITH {i.FACTS} SELECT DISTINCT host, taken, section, key FROM facts")
def stream_deduplicated(spark, sf_dir):
    facts = i.facts_of(event_stream(spark, sf_dir))
    # Days arrive in any order inside the one file, so the watermark spans the month.
    once = means.deduplicated(facts, late="40 days")
    return _plain_times(run(spark, once, "once"), "taken").select("host", "taken", "section", "key")
