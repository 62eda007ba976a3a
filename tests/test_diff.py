import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsdiff.operators import chunks, dedupe, diff, windows
from opsdiff.operators.windows import Windows
from opsdiff.sources.catalog import builtin_catalog
from tests.helpers import A0, A1, B0, B1, SAMPLE, WINDOWS, at, dicts, samples, tuples, two_sided

LOAD, FREE, IDLE = "kernel.all.load", "mem.util.available", "kernel.all.cpu.idle"


@pytest.fixture(scope="module")
def catalog(spark):
    return builtin_catalog(spark)


def rows(spark, catalog, data, windows_=WINDOWS):
    return diff.window_diff(two_sided(spark, data), catalog, windows_)


def test_verdicts_order_and_catalog_filter(spark, catalog):
    got = rows(spark, catalog, [
        ("h", FREE, "", 1000, 500), ("h", LOAD, "1", 1, 6), ("h", IDLE, "", 100, 105), ("h", "not.listed", "", 1, 9),
    ])
    ordered = dicts(diff.in_report_order(got), "metric", "verdict", "category")
    assert [(r["metric"], r["verdict"]) for r in ordered] == [(IDLE, "flat"), (LOAD, "worse"), (FREE, "worse")]
    assert ordered[0]["category"] == "CPU"


def test_own_threshold_wins(spark, catalog):
    icmp = "network.icmp.inmsgs"  # own threshold 300 %
    got = rows(spark, catalog, [("h", icmp, "a", 100, 250), ("h", icmp, "b", 100, 600)])
    assert tuples(got, "instance", "verdict") == [("a", "flat"), ("b", "watch")]


def test_one_sided_keys_and_hosts_are_kept_apart(spark, catalog):
    got = rows(spark, catalog, [
        ("h1", LOAD, "1", 1, None), ("h1", LOAD, "5", None, 2), ("h2", LOAD, "1", 2, 2), ("h2", LOAD, "5", 2, 4),
    ])
    assert tuples(got, "host", "instance", "kind", "a", "b") == sorted([
        ("h1", "1", "gone", 1.0, None), ("h1", "5", "new", None, 2.0),
        ("h2", "1", "flat", 2.0, 2.0), ("h2", "5", "worse", 2.0, 4.0)], key=repr)


def test_windows_are_half_open(spark, catalog):
    data = samples(spark, [
        ("h", "10:00", LOAD, "", 1.0), ("h", "10:59:59.999", LOAD, "", 3.0), ("h", "11:00", LOAD, "", 99.0),
        ("h", "12:00", LOAD, "", 8.0), ("h", "13:00", LOAD, "", 99.0),
    ])
    assert tuples(diff.window_diff(data, catalog, WINDOWS), "a", "b") == [(2.0, 8.0)]


def test_overlapping_windows_share_samples(spark, catalog):
    data = samples(spark, [("h", "10:30", LOAD, "", 2.0), ("h", "11:30", LOAD, "", 4.0)])
    w = Windows(A0, datetime(2024, 3, 1, 12), A0, datetime(2024, 3, 1, 11))
    assert tuples(diff.window_diff(data, catalog, w), "a", "b") == [(3.0, 2.0)]


def test_units_come_from_b_else_a(spark, catalog):
    data = spark.createDataFrame([
        ("h", at("10:30"), LOAD, "x", 1.0, "old"), ("h", at("12:30"), LOAD, "x", 2.0, "new"),
        ("h", at("10:30"), LOAD, "y", 1.0, "old"),
    ], SAMPLE)
    got = diff.window_diff(data, catalog, WINDOWS)
    assert tuples(got, "instance", "units", "a", "b") == [("x", "new", 1.0, 2.0), ("y", "old", 1.0, None)]


def test_null_values_are_missing(spark, catalog):
    data = samples(spark, [("h", "10:30", LOAD, "", None), ("h", "12:30", LOAD, "", 2.0)])
    assert tuples(diff.window_diff(data, catalog, WINDOWS), "kind") == [("new",)]


def test_means_tables_last_row_counts(spark, catalog):
    schema = "host string, metric string, instance string, val double, units string, seq long"
    a = spark.createDataFrame([("h", LOAD, "", 1.0, "u", 0), ("h", LOAD, "", 2.0, "u", 1)], schema)
    b = spark.createDataFrame([("h", LOAD, "", 4.0, "v", 0)], schema)
    assert tuples(diff.means_diff(a, b, catalog, 15), "a", "b", "units") == [(2.0, 4.0, "v")]


def test_same_windows_give_no_change_and_swap_mirrors(spark, catalog):
    rng = random.Random(1)
    names = catalog.names
    data = [
        (f"h{rng.randrange(3)}", rng.choice(names), f"i{rng.randrange(4)}",
         rng.choice([None, 0.0, rng.uniform(-50, 500)]), rng.choice([None, 0.0, rng.uniform(-50, 500)]))
        for _ in range(400)
    ]
    same = Windows(A0, A1, A0, A1)
    assert diff.focus(rows(spark, catalog, data, same)).count() == 0
    there = rows(spark, catalog, data)
    back = rows(spark, catalog, data, Windows(B0, B1, A0, A1))
    mirror = {"new": "gone", "gone": "new"}
    pick = lambda df: {(r.host, r.metric, r.instance): r.kind for r in df.collect()}
    assert {k: mirror.get(v, "-") for k, v in pick(there).items()} == {
        k: v if v in mirror else "-" for k, v in pick(back).items()}


def test_single_pass_equals_join_of_two_scans(spark, catalog):
    rng = random.Random(2)
    data = samples(spark, [
        (f"h{rng.randrange(3)}", f"{rng.randrange(10, 13)}:{rng.randrange(60):02}", rng.choice(catalog.names[:9]),
         f"i{rng.randrange(5)}", rng.uniform(0, 100)) for _ in range(600)])
    key = ["host", "metric", "instance"]
    a = windows.window_means(data, A0, A1).withColumnRenamed("val", "a")
    b = windows.window_means(data, B0, B1).withColumnRenamed("val", "b")
    joined = {tuple(r[:3]): (r.a, r.b) for r in a.join(b, key, "full_outer").select(*key, "a", "b").collect()}
    single = {tuple(r[:3]): (r.a, r.b) for r in windows.paired_means(data, WINDOWS).select(*key, "a", "b").collect()}
    assert joined.keys() == single.keys()
    for k, (x, y) in joined.items():
        assert single[k] == (pytest.approx(x) if x is not None else None, pytest.approx(y) if y is not None else None)


def test_partitioned_table_prunes_days(spark, catalog, tmp_path):
    rows_ = [("h", datetime(2024, 3, d, 10, 30), LOAD, "", float(d), "u") for d in range(1, 9)]
    df = spark.createDataFrame(rows_, SAMPLE).withColumn("date", F.to_date("ts"))
    df.write.partitionBy("date").parquet(str(tmp_path / "s"))
    table = spark.read.parquet(str(tmp_path / "s"))
    w = Windows(datetime(2024, 3, 2), datetime(2024, 3, 3), datetime(2024, 3, 7), datetime(2024, 3, 8))
    got = diff.window_diff(table, catalog, w)
    assert tuples(got, "a", "b") == [(2.0, 7.0)]
    # Days, times and metric names are filters of the scan, and only needed columns are read.
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    lines = got._jdf.queryExecution().explainString(mode).splitlines()
    pick = lambda name: next(line for line in lines if line.startswith(name))
    assert "date#" in pick("PartitionFilters")
    assert "GreaterThanOrEqual(ts" in pick("PushedFilters") and "metric" in pick("PushedFilters")
    assert pick("ReadSchema") == (
        "ReadSchema: struct<host:string,ts:timestamp_ntz,metric:string,instance:string,value:double,units:string>"
    )


def test_window_checks():
    start = datetime(2024, 1, 1)
    for end, days in [(start, None), (start - timedelta(1), None), (start + timedelta(33), 32)]:
        with pytest.raises(ValueError):
            windows.check_window(start, end, days)
    windows.check_window(start, start + timedelta(32), 32)
    with pytest.raises(ValueError):
        windows.check_windows(Windows(A0, A1, B0, B1, -1))
    with pytest.raises(ValueError):
        windows.check_windows(Windows(A0, A1, B0, B1, 10001))


def test_window_presets():
    now = datetime(2024, 3, 5, 14, 37, 12)
    w = windows.windows_for("yesterday", now)
    assert (w.a_start, w.b_start, w.b_end) == (datetime(2024, 3, 4, 13), datetime(2024, 3, 5, 13), datetime(2024, 3, 5, 14))
    w = windows.windows_for("previous_hour", now)
    assert (w.a_start, w.a_end) == (datetime(2024, 3, 5, 12), datetime(2024, 3, 5, 13))
    w = windows.windows_for("today", now)
    assert (w.a_start, w.a_end, w.b_end) == (datetime(2024, 3, 4), datetime(2024, 3, 5), now)
    with pytest.raises(ValueError):
        windows.windows_for("tomorrow", now)


# ---- counters and order-dependent steps over chunk borders -----------------


def series(spark, seed, n=400):
    rng = random.Random(seed)
    rows_, value = [], 0.0
    for i in range(n):
        second = rng.randrange(10800)
        rows_.append((rng.choice(["hot"] * 8 + ["a", "b"]), at("10:00") + timedelta(seconds=second, microseconds=i), LOAD, "", float(rng.randrange(1000)), "u"))
    return spark.createDataFrame(rows_, SAMPLE), rows_


@pytest.mark.parametrize("chunk", [timedelta(seconds=1), timedelta(minutes=7), timedelta(days=1)])
def test_counter_rates_equal_brute_force(spark, chunk):
    df, rows_ = series(spark, 3)
    want = {}
    for host in {r[0] for r in rows_}:
        mine = sorted((r[1], r[4]) for r in rows_ if r[0] == host)
        steps = [(v - u, (t - s).total_seconds()) for (s, u), (t, v) in zip(mine, mine[1:]) if v >= u]
        want[host] = sum(d for d, _ in steps) / sum(s for _, s in steps)
    got = {r.host: r.val for r in windows.counter_rates(df, chunk=chunk).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("chunk", [timedelta(seconds=1), timedelta(hours=1)])
def test_time_weighted_means_equal_brute_force(spark, chunk):
    df, rows_ = series(spark, 4)
    end = at("13:00")
    want = {}
    for host in {r[0] for r in rows_}:
        mine = sorted((r[1], r[4]) for r in rows_ if r[0] == host) + [(end, 0.0)]
        spans = [(u, (t - s).total_seconds()) for (s, u), (t, _) in zip(mine, mine[1:])]
        want[host] = sum(u * s for u, s in spans) / sum(s for _, s in spans)
    got = {r.host: r.val for r in windows.time_weighted_means(df, at("10:00"), end, chunk).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_counter_reset_and_kind(spark, catalog):
    data = samples(spark, [
        ("h", "10:00", LOAD, "", 100.0), ("h", "10:01", LOAD, "", 160.0), ("h", "10:02", LOAD, "", 10.0), ("h", "10:03", LOAD, "", 70.0),
        ("h", "12:00", LOAD, "", 0.0), ("h", "12:01", LOAD, "", 120.0), ("h", "12:30", FREE, "", 5.0), ("h", "10:30", FREE, "", 5.0),
        ("h", "12:30", IDLE, "", 5.0),
    ]).withColumn("kind", F.when(F.col("metric").isin(LOAD, IDLE), "counter").otherwise("instant"))
    got = diff.window_diff(data, catalog, WINDOWS)
    # a counter seen once in a window has no rate
    assert tuples(got, "metric", "a", "b") == [(LOAD, 1.0, 2.0), (FREE, 5.0, 5.0)]


@pytest.mark.parametrize("chunk", [timedelta(seconds=30), timedelta(hours=2)])
def test_previous_and_asof_equal_brute_force(spark, chunk):
    rng = random.Random(5)
    times = sorted({(rng.choice("aaab"), at("10:00") + timedelta(seconds=rng.randrange(7200))) for _ in range(150)})
    df = spark.createDataFrame(times, "k string, ts timestamp_ntz")
    got = {(r.k, r.ts): r.prev for r in chunks.with_previous(df, ["k"], "ts", "ts", "prev", chunk).collect()}
    want = {(k, t): max((s for j, s in times if j == k and s < t), default=None) for k, t in times}
    assert got == want
    asks = [(i, rng.choice("aabc"), at("09:50") + timedelta(seconds=rng.randrange(9000))) for i in range(150)]
    anchors = spark.createDataFrame(asks, "id int, k string, t timestamp_ntz")
    found = chunks.latest_at_or_before(anchors, df, "k", "t", "ts", "hit", chunk)
    assert {r.id: r.hit for r in found.collect()} == {
        i: max((s for j, s in times if j == k and s <= t), default=None) for i, k, t in asks}


# ---- counts, bars, top, fold ----------------------------------------------


def test_counts_bars_and_top(spark, catalog):
    data = [("h", LOAD, str(i), 10, 10 + 10 * i) for i in range(1, 8)] + [("h", LOAD, "z", 0, 5), ("h", LOAD, "n", None, 5), ("g", LOAD, "", 10, 11)]
    r = rows(spark, catalog, data)
    counts = {c["host"]: c for c in dicts(diff.verdict_counts(r))}
    assert (counts["h"]["n_worse"], counts["h"]["n_new"], counts["g"]["n_flat"]) == (8, 1, 1)
    top = dicts(diff.top_worst(r).orderBy("rank"), "instance", "delta_pct")
    assert [t["instance"] for t in top] == ["7", "6", "5", "4", "3"]
    few = dicts(diff.top_worst(rows(spark, catalog, data[5:])).orderBy("rank"), "instance")
    # 0 -> x has no percentage and ranks last among the worse rows
    assert [t["instance"] for t in few] == ["7", "6", "z"]
    bars = {(b["host"], b["instance"]): (b["scale"], b["bar"]) for b in dicts(diff.with_bars(r))}
    assert bars["h", "7"] == (700.0, 50.0) and bars["g", ""] == (100.0, 5.0) and bars["h", "n"] == (700.0, None)


def test_fold_needs_more_than_four(spark, catalog):
    cpu = "kernel.percpu.cpu.user"
    four = rows(spark, catalog, [("h", cpu, str(i), 100, 100 * i) for i in range(1, 5)])
    assert diff.fold_instances(four).count() == 4
    five = rows(spark, catalog, [("h", cpu, str(i), 100, 100 * i) for i in range(1, 6)] + [("h", LOAD, str(i), 1, 9) for i in range(6)])
    folded = dicts(diff.fold_instances(five), "metric", "instances", "instance", "b_min", "b_max")
    assert {"metric": cpu, "instances": 5, "instance": "5", "b_min": 100.0, "b_max": 500.0} in folded
    assert len(folded) == 1 + 6


def test_duplicates_and_warnings(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z"), ("a", 3, "w")], "k string, n int, v string")
    assert tuples(dedupe.dedupe_first(df, ["k"], "n"), "k", "v") == [("a", "y"), ("b", "z")]
    assert tuples(dedupe.dedupe_last(df, ["k"], "n"), "k", "v") == [("a", "w"), ("b", "z")]
    warn = lambda *ws: spark.createDataFrame([("h", i, w) for i, w in enumerate(ws)], "host string, seq int, warning string")
    merged = dedupe.union_warnings(warn("p", "q", "p"), warn("q", "r"))
    assert [w["warning"] for w in dicts(merged.orderBy("seen"))] == ["p", "q", "r"]
    named = dedupe.coverage(warn("Error for a.b_c: unknown", "Error for a.b_c: gone", "other"))
    assert tuples(named, "metric") == [("a.b_c",), ("other",)]


def test_missing_metrics(spark, catalog):
    data = two_sided(spark, [("h1", m, "", 1, 1) for m in catalog.names[2:]] + [("h2", m, "", 1, 1) for m in catalog.names])
    hosts = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "host string")
    got = dedupe.missing_catalog_metrics(data, catalog, hosts)
    assert tuples(got.where("host = 'h1'"), "metric") == sorted((m,) for m in catalog.names[:2])
    assert got.where("host = 'h2'").count() == 0 and got.where("host = 'h3'").count() == 146


def test_copies_of_a_sample_change_nothing_in_rates(spark):
    once = [("h", "10:00", LOAD, "", 5.0), ("h", "10:10", LOAD, "", 11.0), ("h", "10:20", LOAD, "", 11.0)]
    rate = lambda data: tuples(windows.counter_rates(samples(spark, data)), "val")
    assert rate(once) == rate(once * 40) == [(0.005,)]


def test_series_without_a_kind_count_as_instants(spark):
    data = two_sided(spark, [("h", LOAD, "", 1, 6)]).withColumn("kind", F.lit(None).cast("string"))
    assert tuples(windows.paired_means(data, WINDOWS), "metric", "a", "b") == [(LOAD, 1.0, 6.0)]


WINDOW = "host string, a_start timestamp_ntz, a_end timestamp_ntz, b_start timestamp_ntz, b_end timestamp_ntz, threshold_pct double"


@pytest.mark.parametrize("bad", [(A1, A0, B0, B1, 10.0), (A0, A1, B0, None, 10.0), (A0, A1, B0, B1, -1.0)])
def test_bad_windows_per_host_are_refused(spark, bad):
    per_host = spark.createDataFrame([("g", A0, A1, B0, B1, 10.0), ("h", *bad)], WINDOW)
    with pytest.raises(ValueError, match="'h'"):
        windows.paired_means(two_sided(spark, [("h", LOAD, "", 1, 6)]), per_host)


def test_windows_per_host_open_their_day_folders_only(spark, tmp_path):
    path = str(tmp_path / "samples")
    data = two_sided(spark, [("h", LOAD, "", 1, 6)])
    data.withColumn("date", F.to_date("ts")).write.partitionBy("date").parquet(path)
    per_host = spark.createDataFrame([("h", A0, A1, B0, B1, 10.0)], WINDOW)
    means = windows.paired_means(spark.read.parquet(path), per_host)
    assert tuples(means, "a", "b") == [(1.0, 6.0)]
    plan = means._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
