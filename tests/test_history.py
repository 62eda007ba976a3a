"""Histories of facts and counters: one shuffle each, and the same as going through them one by one."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsdiff.operators import state, windows
from opsdiff.operators.chunks import DAY, HOUR, latest_at_or_before
from opsdiff.plans.reports import state_report
from tests.helpers import SAMPLE, exchanges, scans, tuples

FACT = "host string, taken timestamp_ntz, section string, title string, key string, value string, note string, seq int"
START = datetime(2024, 3, 1)


def made(seed=5):
    """Snapshots at uneven times; values change, go, come back, and are delivered twice."""
    rng, rows = random.Random(seed), []
    for host in ("a", "b", "alone"):
        times = sorted(rng.sample(range(5000), 1 if host == "alone" else 25))
        for n, hours in enumerate(times):
            for key in range(12):
                if rng.random() < 0.8:
                    value = str(rng.randrange(2)) if key % 3 else "same"
                    for seq in range(rng.choice([1, 1, 2])):
                        rows.append((host, START + timedelta(hours=hours), f"s{key % 2}", f"t{n % 3}", f"k{key}", value if seq else value + "!" * rng.randrange(2), f"n{n}", seq))
    return rows


def snapshots(rows):
    """host -> [(taken, {(section, key): (value, note)}, {section: title})] in order."""
    out = {}
    for host, taken, section, title, key, value, note, seq in sorted(rows, key=lambda r: (r[0], r[1], r[7])):
        facts, titles = out.setdefault(host, {}).setdefault(taken, ({}, {}))
        facts[section, key] = value, note
        titles[section] = max(title, titles.get(section, ""))
    return {host: sorted((t, *x) for t, x in by.items()) for host, by in out.items()}


def by_hand(rows):
    changes, intervals = [], []
    for host, shots in snapshots(rows).items():
        for (a, old, ta), (b, new, tb) in zip(shots, shots[1:]):
            for section, key in old.keys() | new.keys():
                was, now = old.get((section, key)), new.get((section, key))
                if was is None or now is None or was[0] != now[0]:
                    kind = "added" if was is None else "removed" if now is None else "modified"
                    changes.append((host, a, b, section, tb.get(section) or ta.get(section), key, kind, was and was[0], now and now[0], (now or was)[1]))
        for fact in {f for _, facts, _ in shots for f in facts}:
            run = None
            for taken, facts, _ in [*shots, (None, {}, {})]:
                now = facts.get(fact)
                if run and (now is None or now[0] != run[0]):
                    intervals.append((host, *fact, run[0], run[1], run[2], run[3], taken))
                    run = None
                if now is not None:
                    run = [*now, taken, taken] if run is None else [*run[:3], taken]
    return sorted(changes, key=repr), sorted(intervals, key=repr)


@pytest.mark.parametrize("stored", [False, True])
def test_consecutive_diff_and_intervals_by_hand(spark, stored):
    rows = made()
    facts = spark.createDataFrame(rows, FACT)
    changes, intervals = by_hand(rows)
    sections = facts.select("host", "taken", "section", "title").distinct() if stored else None
    headers = state.headers_of(facts) if stored else None
    got = state.consecutive_diff(facts, headers, sections)
    assert tuples(got, "host", "a_taken", "b_taken", "section", "title", "key", "kind", "old", "new", "note") == changes
    assert tuples(state.fact_intervals(facts, headers), "host", "section", "key", "value", "note", "since", "until", "ended") == intervals


def test_a_snapshot_without_facts_is_a_gap(spark):
    facts = spark.createDataFrame([("h", START + d * DAY, "s", "", "k", "1", "", 0) for d in (0, 2)], FACT)
    assert state.consecutive_diff(facts).count() == 0
    headers = spark.createDataFrame([("h", START + d * DAY) for d in range(4)], "host string, taken timestamp_ntz")
    got = state.consecutive_diff(facts, headers)
    assert tuples(got, "b_taken", "kind") == [(START + DAY, "removed"), (START + 2 * DAY, "added"), (START + 3 * DAY, "removed")]
    assert tuples(state.fact_intervals(facts, headers), "since", "until", "ended") == [(START, START, START + DAY), (START + 2 * DAY, START + 2 * DAY, START + 3 * DAY)]


def test_facts_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame(made(), FACT).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    headers = spark.createDataFrame(state.headers_of(facts).collect())
    plain = facts.drop("title")
    for df in (state.consecutive_diff(plain, headers), state.fact_intervals(plain, headers)):
        assert exchanges(df, "section", "key") == 1 and scans(df) == 1


def test_a_state_report_reads_headers_once_and_facts_once(spark, tmp_path):
    spark.createDataFrame(made(), FACT).write.parquet(str(tmp_path / "facts"))
    report = state_report(spark.read.parquet(str(tmp_path / "facts")))
    assert scans(report.pairs) == 1
    assert scans(report.changes) == 2  # headers, and facts; titles come from the facts' shuffle


# Counters

def rate_by_hand(points):
    """points: time -> value; growth over time of the steps that do not fall."""
    growth = span = 0.0
    for (t, v), (u, w) in zip(sorted(points.items()), sorted(points.items())[1:]):
        if w >= v:
            growth, span = growth + w - v, span + (u - t).total_seconds()
    return growth / span if span else None


@pytest.mark.parametrize("chunk", [timedelta(minutes=1), HOUR, DAY])
def test_counter_rates_by_hand(spark, chunk):
    """Samples on chunk borders, alone in a chunk, delivered twice, with two values at one time, and resets."""
    rng, rows, want = random.Random(9), [], {}
    for n in range(30):
        points, value = {}, 0.0
        at = START
        for _ in range(rng.randrange(1, 40)):
            at += rng.choice([timedelta(minutes=1), timedelta(seconds=20), HOUR, timedelta(hours=7), timedelta(days=2)])
            value = float(rng.randrange(10)) if rng.random() < 0.2 else value + rng.randrange(100)
            points[at] = value
            rows += [("h", at, "m", f"i{n}", value, "u")] * rng.choice([1, 1, 5])
            if rng.random() < 0.2:
                rows.append(("h", at, "m", f"i{n}", value - 1, "u"))
        rows.append(("h", at, "m", f"i{n}", None, "u"))
        want[f"i{n}"] = rate_by_hand(points)
    rng.shuffle(rows)
    samples = spark.createDataFrame(rows, SAMPLE).repartition(7)
    got = {r["instance"]: r["val"] for r in windows.counter_rates(samples, chunk=chunk).collect()}
    assert got.keys() == {k for k, v in want.items() if v is not None}
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)


def test_time_weighted_mean_by_hand(spark):
    end = START + 2 * DAY
    rows = [("h", START + timedelta(minutes=m), "m", "", float(v), "u") for m, v in [(0, 1), (50, 4), (60, 2), (61, 8), (1500, 3)]]
    held = 50 * 1 + 10 * 4 + 1 * 2 + 1439 * 8 + (2880 - 1500) * 3
    for chunk in (timedelta(minutes=1), HOUR, DAY):
        got = windows.time_weighted_means(spark.createDataFrame(rows, SAMPLE), START, end, chunk)
        assert [r["val"] for r in got.collect()] == [pytest.approx(held / 2880)]


def test_samples_are_gathered_before_one_shuffle(spark):
    samples = spark.createDataFrame([("h", START, "m", "", 1.0, "u")], SAMPLE)
    rates = windows.counter_rates(samples)
    assert exchanges(rates, "ts") == 0 and exchanges(rates, "p") == 0
    assert exchanges(rates) == 2 and exchanges(rates, "metric", "_chunk", "buf") == 1  # gathered points, then one row a chunk


# As-of join

def asof_by_hand(anchors, times):
    return sorted(((*a, max((t for h, t in times if h == a[0] and t <= a[1]), default=None)) for a in anchors), key=repr)


@pytest.mark.parametrize("chunk, depth", [(DAY, 1 << 17), (DAY, 3), (HOUR, 1), (timedelta(minutes=1), 2)])
def test_asof_join_by_hand(spark, chunk, depth):
    rng = random.Random(3)
    moment = lambda: START + timedelta(minutes=rng.randrange(0, 20000, 30))
    anchors = [(rng.choice("aaab"), moment(), n) for n in range(300)] + [("a", START, -1)] * 20 + [("nobody", START, -2), (None, START, -3), ("a", None, -4)]
    times = [(rng.choice("ab"), moment()) for _ in range(60)] * 2 + [("c", START)]
    got = latest_at_or_before(
        spark.createDataFrame(anchors, "host string, t timestamp_ntz, id int").repartition(4),
        spark.createDataFrame(times, "host string, taken timestamp_ntz"), "host", "t", "taken", "taken", chunk, depth)
    usable = [a for a in anchors if a[1] is not None]
    assert sorted(map(tuple, got.where("t is not null").collect()), key=repr) == asof_by_hand(usable, times)
    assert got.count() == len(anchors)


def test_a_busy_host_is_spread(spark):
    """Half of all anchors are one host's, at one moment, and copies of one row, from many files."""
    n, parts = 40_000, 64
    busy = F.col("id") % 2 == 0
    anchors = spark.range(0, n, 1, 256).select(
        F.when(busy, "busy").otherwise(F.concat(F.lit("h"), F.col("id") % 997)).alias("host"),
        F.lit(START).cast("timestamp_ntz").alias("t") + F.make_dt_interval(hours=F.when(busy, 5).otherwise(F.col("id") % 700).cast("int")),
        F.when(~busy, F.col("id")).alias("id")).toDF("host", "t", "id")
    times = spark.range(2000).select(F.concat(F.lit("h"), F.col("id") % 997).alias("host"), F.lit(START).cast("timestamp_ntz").alias("taken"))
    times = times.unionByName(spark.createDataFrame([("busy", START + HOUR * k) for k in range(9)], times.schema))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = latest_at_or_before(anchors, times, "host", "t", "taken", "taken", DAY, depth=n // (16 * parts))
        sizes = sorted(r["count"] for r in got.select(F.spark_partition_id().alias("p"), "taken").groupBy("p").agg(F.count("*").alias("count"), F.max("taken")).collect())
        assert len(sizes) == parts and sum(sizes) == n and sizes[-1] < 3 * sizes[parts // 2]
        assert got.where("host = 'busy'").select("taken").distinct().collect()[0][0] == START + 5 * HOUR
        assert exchanges(got, "_row") == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
