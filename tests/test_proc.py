from datetime import datetime

from opsdiff.operators import proc
from opsdiff.operators.windows import Windows
from opsdiff.plans.reports import proc_report
from opsdiff.plans.text_reports import LINE_ORDER, proc_lines
from tests.helpers import A0, A1, B0, B1, dicts, tuples, two_sided

UT, ST, RSS, START = proc.PROC_METRICS
W = Windows(A0, A1, B0, B1, 20.0)


def test_aggregation_by_name(spark):
    means = spark.createDataFrame([
        ("h", UT, "10 nginx", 40.0), ("h", ST, "10 nginx", 5.0), ("h", UT, "11 /usr/sbin/nginx", 15.0),
        ("h", RSS, "10 nginx", 3000.0), ("h", RSS, "11 nginx", 7000.0), ("h", UT, "20 redis", 9.0),
        ("h", RSS, "30 only-rss", 1.0), ("h", UT, "40", 99.0), ("h", "other.metric", "10 nginx", 99.0),
    ], "host string, metric string, instance string, val double")
    assert tuples(proc.proc_samples(means), "name", "cpu_ms", "rss", "start_time", "n") == [
        ("nginx", 60.0, 7000.0, 0.0, 5), ("only-rss", 0.0, 1.0, 0.0, 1), ("redis", 9.0, 0.0, 0.0, 1)]


def test_verdicts_restarts_and_order(spark):
    data = two_sided(spark, [
        ("h", UT, "1 grow", 10, 100), ("h", UT, "2 shrink", 100, 10), ("h", UT, "3 same", 10, 11),
        ("h", UT, "4 fresh", None, 7), ("h", RSS, "5 left", 7, None), ("h", UT, "6 zero", 0, 3),
        ("h", START, "1 grow", 1e6, 1e6 + 60001), ("h", START, "3 same", 1e6, 1e6 + 60000),
    ])
    report = proc_report(data, W)
    cpu = dicts(proc.in_proc_order(report.cpu()), "name", "verdict")
    assert [(r["name"], r["verdict"]) for r in cpu] == [
        ("grow", "worse"), ("zero", "worse"), ("fresh", "appeared"), ("left", "gone"), ("shrink", "better"), ("same", "flat")]
    mem = {r["name"]: (r["a"], r["b"], r["verdict"], r["unit"]) for r in dicts(report.mem())}
    assert mem["grow"] == (0.0, 0.0, "flat", "KB") and mem["left"] == (7.0, None, "gone", "KB")
    assert tuples(report.restarts, "name", "start_a", "start_b") == [("grow", 1e6, 1e6 + 60001)]
    flags = {(r["name"], r["metric"]): r["restarted"] for r in dicts(report.rows)}
    assert flags["grow", "mem"] and not flags["same", "cpu"]


def test_windows_per_host(spark):
    data = two_sided(spark, [("h", UT, "1 x", 100, 115), ("g", UT, "1 x", 100, 115)])
    per_host = spark.createDataFrame(
        [("h", A0, A1, B0, B1, 20.0), ("g", A0, A1, B0, B1, 10.0)],
        "host string, a_start timestamp_ntz, a_end timestamp_ntz, b_start timestamp_ntz, b_end timestamp_ntz, threshold_pct double")
    assert tuples(proc.proc_diff(data, per_host).where("metric = 'cpu'"), "host", "verdict") == [("g", "worse"), ("h", "flat")]


def test_hosts_without_data(spark):
    hosts = spark.createDataFrame([("h",), ("none",)], "host string")
    report = proc_report(two_sided(spark, [("h", UT, "1 x", 1, 1)]), W, hosts)
    assert tuples(report.no_data, "host") == [("none",)]


def test_text(spark):
    now = datetime(2024, 3, 1, 14)
    ms = now.timestamp() * 1000
    data = two_sided(spark, [
        ("h", UT, "1 web", 10, 100), ("h", START, "1 web", ms - 3 * 86400000, ms - 7200000), ("h", RSS, "1 web", 5, 5),
    ])
    lines = proc_lines(proc_report(data, W), now).orderBy("host", *LINE_ORDER)
    assert [r["line"] for r in dicts(lines)] == [
        "process report", "  A 03-01 10:00 ~ 11:00", "  B 03-01 12:00 ~ 13:00  (threshold 20%)", "",
        "⟳ restarted between the windows", "  web  3d ago → 2h ago", "",
        "== Processor time (more is worse) ==  (1 changed)",
        "  web ⟳  10.00  100.00  +900.0%  worse  ms/s", "",
        "== Memory ==  (0 changed)", "  nothing changed much", "",
    ]
