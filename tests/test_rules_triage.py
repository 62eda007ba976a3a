import json

import pytest
from pyspark.sql import functions as F

from opsdiff.operators import diff, rules, triage
from opsdiff.plans.reports import compare
from opsdiff.plans.text_reports import LINE_ORDER, diff_lines
from opsdiff.sources.catalog import builtin_catalog
from opsdiff.sources.rules import builtin_rules, load_rules
from tests.helpers import WINDOWS, dicts, tuples, two_sided


@pytest.fixture(scope="module")
def judged(spark):
    catalog = builtin_catalog(spark)
    return lambda data: diff.window_diff(two_sided(spark, data), catalog, WINDOWS)


@pytest.fixture(scope="module")
def builtin(spark):
    return builtin_rules(spark)


def test_two_conditions_give_two_pieces_of_evidence(judged, builtin):
    rows = judged([
        ("h", "disk.dev.avactive", "sdb", 10, 30), ("h", "disk.dev.avactive", "sda", 10, 20),
        ("h", "disk.dev.aveq", "sda", 1, 4), ("g", "disk.dev.avactive", "sda", 10, 30),
    ])
    got = dicts(rules.findings(rows, builtin))
    assert len(got) == 1
    # the first row in report order, conditions in rule order
    assert got[0]["host"] == "h" and got[0]["id"] == "disk-saturated"
    assert got[0]["evidence"] == ["disk.dev.avactive[sda] Δ+100.0%", "disk.dev.aveq[sda] Δ+300.0%"]


def test_thresholds_in_conditions(judged, builtin):
    rows = judged([
        ("a", "kernel.all.cpu.steal", "", 20, 39), ("b", "kernel.all.cpu.steal", "", 20, 40),
        ("c", "filesys.full", "/", 50, 89), ("d", "filesys.full", "/", 50, 90),
        ("e", "kernel.all.uptime", "", 1000, 501), ("f", "kernel.all.uptime", "", 1000, 500),
    ])
    got = rules.findings(rows, builtin)
    assert tuples(got, "host", "id") == [("b", "steal"), ("d", "fs-filling"), ("f", "rebooted")]
    assert [r["id"] for r in dicts(rules.by_severity(got.withColumn("host", F.lit("x"))), "id")] == ["fs-filling", "steal", "rebooted"]


def test_appeared_row_is_watch_but_may_be_positive(judged, builtin):
    # worse never holds for a row that appeared; b > 0 alone does
    rows = judged([("h", "network.tcp.listendrops", "", None, 3), ("h", "mem.vmstat.oom_kill", "", None, 3)])
    got = dicts(rules.findings(rows, builtin))
    assert [(r["id"], r["evidence"]) for r in got] == [("accept-overflow", ["network.tcp.listendrops (new)"])]


def test_no_rows_no_findings(judged, builtin):
    assert rules.findings(judged([]), builtin).count() == 0


def test_loaded_rule_with_appeared(spark, judged, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps([
        {"id": "fresh", "severity": "info", "conclusion": "c", "when": [{"metric": "kernel.all.load", "appeared": True}]},
        {"id": "drop", "severity": "warn", "conclusion": "c", "when": [{"metric": "mem.util.free", "delta_lte": -20}, {"metric": "kernel.all.load"}]},
    ]))
    loaded = load_rules(spark, str(path))
    rows = judged([("h", "kernel.all.load", "1", None, 9), ("h", "mem.util.free", "", 100, 80), ("g", "kernel.all.load", "1", 9, 9)])
    assert tuples(rules.findings(rows, loaded), "host", "id", "evidence") == [
        ("h", "drop", ["mem.util.free Δ-20.0%", "kernel.all.load[1] (new)"]), ("h", "fresh", ["kernel.all.load[1] (new)"])]


def board(df):
    return {(r["host"], r["key"]): (r["status"], r["headline"], r["worst_pct"]) for r in dicts(df)}


def test_board_states(judged):
    got = board(triage.triage(judged([
        ("h", "kernel.all.load", "1", 1, 3),              # core worse
        ("h", "kernel.all.nprocs", "", 100, 200),         # watch only, loses to core
        ("h", "mem.util.cached", "", 100, 200),           # watch
        ("h", "network.tcp.currestab", "", 100, 101),     # flat
        ("g", "kernel.all.entropy.avail", "", None, 100), # appeared, not core
        ("g", "mem.vmstat.oom_kill", "", None, 2),        # appeared, core
        ("g", "filesys.usedfiles", "/", 100, 300),        # worse, not core
    ])))
    assert got["h", "cpu"] == ("bad", "all load[1] +200%", 200.0)
    assert got["h", "mem"] == ("warn", "util cached +100%", 100.0)
    assert got["h", "disk"] == ("ok", "normal", None) and got["h", "net"] == ("ok", "normal", None)
    assert got["g", "cpu"] == ("ok", "normal", None)
    assert got["g", "mem"] == ("warn", "vmstat oom_kill appeared".replace("_", " "), None)
    assert got["g", "disk"] == ("warn", "usedfiles[/] +200%", 200.0)
    assert len(got) == 8


def test_board_picks_the_worst_core_row_and_the_first_amber_one(judged):
    got = board(triage.triage(judged([
        ("h", "kernel.all.load", "1", 1, 3), ("h", "kernel.all.load", "2", 1, 9), ("h", "kernel.all.load", "3", 1, 9),
        ("h", "swap.pagesin", "", 0, 5), ("h", "mem.util.available", "", 1000, 1),
        ("h", "network.interface.in.bytes", "b", 1e6, 9e6), ("h", "network.interface.in.bytes", "a", 1e6, 2e6),
    ])))
    assert got["h", "cpu"][1] == "all load[2] +800%"
    assert got["h", "mem"][:2] == ("bad", "pagesin anomaly")  # an undefined percentage beats any number
    assert got["h", "net"][1] == "interface in bytes[a] +100%"


def test_hosts_without_rows_are_ok(spark, judged, builtin):
    hosts = spark.createDataFrame([("quiet",), ("h",)], "host string")
    rows = judged([("h", "kernel.all.load", "1", 1, 3)])
    got = board(triage.triage(rows, hosts))
    assert len(got) == 8 and {v[0] for (h, _), v in got.items() if h == "quiet"} == {"ok"}
    soft = board(rules.software_block(rules.findings(rows, builtin), hosts))
    assert soft["quiet", "software"][0] == "ok"


def test_compare_report_and_alert(spark):
    data = two_sided(spark, [
        ("sick", "network.tcp.listendrops", "", 0, 5), ("sick", "kernel.all.load", "", 1, 1), ("well", "kernel.all.load", "", 1, 1),
        ("crit", "network.tcp.listendrops", "", 5, 5),
    ])
    with compare(data, WINDOWS) as report:
        assert tuples(report.regressed, "host", "regressed") == [("crit", True), ("sick", True), ("well", False)]
        status = {(r["host"], r["key"]): r["status"] for r in dicts(report.triage)}
        assert status["sick", "software"] == "bad" and status["sick", "net"] == "bad" and status["well", "software"] == "ok"
        assert report.missing.where("host = 'well'").count() == 145
        assert set(report.parts()) == {"rows", "findings", "triage", "counts", "missing", "regressed"}


def test_report_json(spark, tmp_path):
    report = compare(two_sided(spark, [("h", "kernel.all.load", "", 1, None)]), WINDOWS)
    report.to_json(str(tmp_path / "r"))
    row = json.loads(spark.read.text(str(tmp_path / "r" / "rows")).first()[0])
    assert row["a"] == 1.0 and row["b"] is None and row["kind"] == "gone"
    assert spark.read.text(str(tmp_path / "r" / "triage")).count() == 5


def test_diff_text(spark):
    data = two_sided(spark, [
        ("h", "network.tcp.listendrops", "", 2, 3), ("h", "kernel.all.load", "1 minute", 1, 3), ("h", "kernel.all.load", "5 minute", None, 30000),
        ("h", "kernel.all.cpu.idle", "", 100, 100), ("g", "kernel.all.cpu.idle", "", 100, 100),
    ])
    lines = diff_lines(compare(data, WINDOWS)).orderBy("host", *LINE_ORDER)
    text = {h: [r["line"] for r in dicts(lines.where(F.col("host") == h))] for h in "gh"}
    window = "[A 03-01 10:00 -> 11:00] vs [B 03-01 12:00 -> 13:00] · threshold 15%"
    assert text["g"] == ["[diagnosis] no known pattern matched, the rows follow.", "worse 0 · better 0 · watch 0 · flat 1", window, ""]
    assert text["h"][1] == "  evidence: network.tcp.listendrops Δ+50.0%" and text["h"][0].startswith("[CRIT] ")
    assert text["h"][4:] == [
        "worse 2 · better 0 · watch 0 · flat 1 · appeared 1", window, "", "—— CPU ——",
        "x all load [1 minute]  1.00  3.00    +200.0%  worse     u",
        "+ all load [5 minute]  —     30.00k  ⊕        appeared  u",
        "—— Network ——", "x tcp listendrops  2.00  3.00  +50.0%  worse  u"]
    everything = diff_lines(compare(data, WINDOWS), show_all=True)
    assert everything.where("host = 'g' AND line LIKE '. all cpu idle%'").count() == 1
