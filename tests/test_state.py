import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsdiff.operators import state
from opsdiff.plans import text_reports
from opsdiff.plans.reports import state_report, verify_report, verify_start
from tests.helpers import dicts, tuples

FACT = "host string, taken timestamp_ntz, section string, title string, key string, value string, note string, seq int"
D1, D2, D3 = datetime(2024, 3, 1), datetime(2024, 3, 2), datetime(2024, 3, 3)


def facts(spark, taken, *items, host="h", section="sysctl", title="Kernel"):
    """items: (key, value[, note[, seq]])"""
    rows = [(host, taken, section, title, i[0], i[1], i[2] if len(i) > 2 else "", i[3] if len(i) > 3 else 0) for i in items]
    return spark.createDataFrame(rows, FACT)


def test_added_removed_modified(spark):
    a = facts(spark, D1, ("vm.swappiness", "60"), ("old", "x"), ("same", "1"))
    b = facts(spark, D2, ("vm.swappiness", "10"), ("fresh", "y", "n"), ("same", "1", "other note"))
    got = state.state_diff(a, b)
    assert tuples(got, "key", "kind", "old", "new", "note") == sorted([
        ("fresh", "added", None, "y", "n"), ("old", "removed", "x", None, ""), ("vm.swappiness", "modified", "60", "10", "")], key=repr)
    assert dicts(state.change_counts(got, by_section=False)) == [{"host": "h", "total": 3, "added": 1, "removed": 1, "modified": 1}]


def test_identical_states(spark):
    a = facts(spark, D1, ("a", "1"), ("b", ""))
    assert state.state_diff(a, a).count() == 0


def test_empty_value_is_not_absent(spark):
    got = state.state_diff(facts(spark, D1, ("p", "")), facts(spark, D2, ("p", "x"), ("q", "")))
    assert tuples(got, "key", "kind", "old", "new") == [("p", "modified", "", "x"), ("q", "added", None, "")]


def test_last_duplicate_counts(spark):
    a = facts(spark, D1, ("r", "1", "", 0), ("r", "2", "", 1))
    b = facts(spark, D2, ("r", "2", "", 0), ("r", "9", "", 1), ("r", "2", "", 2))
    assert state.state_diff(a, b).count() == 0


def test_hosts_sections_titles(spark):
    a = facts(spark, D1, ("k", "1"), title="Old title").unionByName(facts(spark, D1, ("k", "1"), host="g"))
    b = facts(spark, D2, ("j", "1"), title="New title").unionByName(facts(spark, D2, ("k", "1"), host="g", section="vm", title=""))
    got = tuples(state.state_diff(a, b), "host", "section", "title", "key", "kind")
    assert got == sorted([
        ("g", "sysctl", "Kernel", "k", "removed"), ("g", "vm", "", "k", "added"),
        ("h", "sysctl", "New title", "j", "added"), ("h", "sysctl", "New title", "k", "removed")], key=repr)
    bare = state.state_diff(a.drop("title", "note", "seq"), b.drop("title", "note", "seq"))
    assert {r["title"] for r in dicts(bare)} == {"Kernel parameters", "vm"}


def test_skipped_sections_can_be_left_out(spark):
    a, b = facts(spark, D1, ("k", "1")), facts(spark, D2)
    assert state.state_diff(a, b).count() == 1
    skipped = spark.createDataFrame([("h", "sysctl")], "host string, section string")
    assert state.state_diff(a, b, skipped).count() == 0


def test_report_order_of_sections(spark):
    names = ["modules", "network", "unknown", "configs", "listen"]
    b = facts(spark, D2, ("k", "1"), section=names[0])
    for name in names[1:]:
        b = b.unionByName(facts(spark, D2, ("b", "1"), ("a", "1"), section=name))
    got = dicts(state.in_change_order(state.state_diff(b.limit(0), b)), "section", "key")
    assert [r["section"] for r in got if r["key"] != "b"] == ["network", "listen", "configs", "modules", "unknown"]
    assert [r["key"] for r in got][:2] == ["a", "b"]


def test_inventory(spark):
    stats = state.snapshot_stats(
        facts(spark, D1, ("a", "1"), ("b", "1")),
        spark.createDataFrame([("h", D1, "modules", "why"), ("h", D1, "sysctl", "")], "host string, taken timestamp_ntz, section string, skipped string"))
    assert tuples(stats, "section", "facts", "skipped") == [("modules", 0, "why"), ("sysctl", 2, None)]
    assert tuples(state.snapshot_totals(stats), "facts", "sections", "skipped") == [(2, 2, 1)]
    assert tuples(state.newest(state.headers_of(history(spark)), 2), "taken", "host") == [(D2, "h"), (D3, "h")]


def test_swap_mirrors(spark):
    rng = random.Random(7)
    make = lambda t: facts(spark, t, *[(f"k{i}", str(rng.randrange(3))) for i in rng.sample(range(60), 40)])
    a, b = make(D1), make(D2)
    mirror = {"added": "removed", "removed": "added", "modified": "modified"}
    there = {(r.key, mirror[r.kind], r.new, r.old) for r in state.state_diff(a, b).collect()}
    assert there == {(r.key, r.kind, r.old, r.new) for r in state.state_diff(b, a).collect()}


def history(spark):
    return (
        facts(spark, D1, ("a", "1"), ("b", "1")).unionByName(facts(spark, D2, ("a", "2"), ("b", "1")))
        .unionByName(facts(spark, D3, ("a", "2"))).unionByName(facts(spark, D2, ("z", "1"), host="single"))
    )


def test_choose_pair(spark):
    headers = state.headers_of(history(spark))
    assert tuples(state.choose_pair(headers), "host", "a_taken", "b_taken") == [("h", D2, D3)]
    assert tuples(state.choose_pair(headers, since=timedelta(days=30)), "a_taken", "b_taken") == [(D1, D3)]
    assert tuples(state.choose_pair(headers, b=datetime(2024, 3, 2, 9)), "a_taken", "b_taken") == [(D1, D2)]
    assert tuples(state.choose_pair(headers, a=datetime(2024, 3, 1, 9)), "a_taken", "b_taken", "host") == [(D1, D3, "h")]
    # a host without a snapshot at or before the moment is left out
    assert state.choose_pair(headers, a=datetime(2024, 2, 1)).count() == 0


def test_asof(spark):
    headers = state.headers_of(history(spark))
    t = datetime(2024, 3, 1, 12)
    assert tuples(state.snapshot_asof(headers, t), "host", "taken") == [("h", D1)]
    assert tuples(state.snapshot_asof(headers, t, strict=False), "host", "taken") == [("h", D1), ("single", D2)]
    assert tuples(state.snapshot_asof(headers, D2), "host", "taken") == [("h", D2), ("single", D2)]
    anchors = spark.createDataFrame([("h", t, 1), ("single", t, 2), ("single", D3, 3), ("nobody", t, 4)], "host string, t timestamp_ntz, id int")
    assert tuples(state.snapshot_asof_join(anchors, headers), "id", "taken") == [(1, D1), (3, D2)]
    assert tuples(state.snapshot_asof_join(anchors, headers, strict=False), "id", "taken") == [(1, D1), (2, D2), (3, D2)]


def test_consecutive_diff_and_counts(spark):
    got = state.consecutive_diff(history(spark))
    assert tuples(got, "b_taken", "key", "kind") == [(D2, "a", "modified"), (D3, "b", "removed")]
    flags = state.changed(got, state.headers_of(history(spark)).select("host").distinct())
    assert tuples(flags, "host", "changed") == [("h", True), ("single", False)]


def test_partitioned_facts(spark, tmp_path):
    from opsdiff.sources.snapshots import read_facts, write_snapshot
    write_snapshot(history(spark), str(tmp_path / "f"))
    stored = read_facts(spark, str(tmp_path / "f"))
    assert tuples(state_report(stored).changes, "key", "kind") == [("b", "removed")]


def test_volatile_keys(spark):
    keys = ["kernel.random.uuid", "fs.dentry-state", "user.max_mnt_namespaces", "net.ipv4.ip_forward", "net.core.somaxconn", "fs.quota.sync", "user"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert [r[0] for r in df.select(state.is_volatile(F.col("key"))).collect()] == [True, True, True, True, False, False, False]


def test_verify_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    name = verify_start(facts(spark, D1, ("vm.swappiness", "60"), ("s", "4096")), path, now=datetime(2024, 3, 1, 9, 8, 7))
    assert name == "release-20240301-090807"
    report = verify_report(spark, name, facts(spark, D2, ("vm.swappiness", "10"), ("s", "4096")), path)
    assert tuples(report.changes, "old", "new") == [("60", "10")]
    assert tuples(report.pairs, "a_taken", "b_taken") == [(D1, D2)]
    with pytest.raises(ValueError):
        verify_report(spark, "unknown", facts(spark, D2), path)


def ordered(lines):
    return [r["line"] for r in dicts(lines.orderBy("host", *text_reports.LINE_ORDER))]


def test_state_text_and_markdown(spark):
    a = facts(spark, D1, ("k|1", "x" * 70), ("b", "1"), section="configs", title="Files").unionByName(facts(spark, D1, ("p", "1"), section="network", title="Net"))
    b = facts(spark, D2, ("k|1", "y`"), section="configs", title="Files").unionByName(
        facts(spark, D2, ("p", "1"), ("q", "2", "sshd"), section="network", title="Net"))
    report = state_report(a.unionByName(b))
    assert ordered(text_reports.state_lines(report)) == [
        "state report", "  A 2024-03-01 00:00:00", "  B 2024-03-02 00:00:00", "", "▲ 3 changes", "",
        "== Net ==  (1)", "  + q = 2  sshd", "",
        "== Files ==  (2)", "  - b  (was 1)", "  ~ k|1: " + "x" * 70 + " → y`", ""]
    assert ordered(text_reports.markdown_lines(report, "T"))[:8] == [
        "## T", "", "- Baseline A: `2024-03-01 00:00:00`", "- Compare B: `2024-03-02 00:00:00`", "",
        "⚠️ **3 changes** - 🟢 1 added · 🟡 1 modified · ⚪ 1 removed", "", "### Net (1)"]
    assert "| 🟡 | `k|1` | `" + "x" * 57 + "...` → `y ` |" in ordered(text_reports.markdown_lines(report))


def test_unknown_sections_keep_their_blocks(spark):
    a = facts(spark, D1, ("a", "1"), section="yy", title="Y").unionByName(facts(spark, D1, ("b", "1"), section="xx", title="X"))
    b = facts(spark, D2, ("a", "2"), section="yy", title="Y").unionByName(facts(spark, D2, ("b", "2"), section="xx", title="X"))
    lines = ordered(text_reports.state_lines(state_report(a.unionByName(b))))
    assert lines[6:] == ["== X ==  (1)", "  ~ b: 1 → 2", "", "== Y ==  (1)", "  ~ a: 1 → 2", ""]


def test_identical_text_and_summary(spark, tmp_path):
    both = facts(spark, D1, ("a", "1")).unionByName(facts(spark, D2, ("a", "1")))
    report = state_report(both)
    assert ordered(text_reports.state_lines(report))[-1] == "Both moments are identical, nothing changed."
    assert ordered(text_reports.markdown_lines(report))[-1].startswith("✅")
    hosts = state.headers_of(both).select("host").distinct()
    assert tuples(text_reports.summary_line(report, hosts, D3), "line") == [("[2024-03-03] no change",)]
    text_reports.write_lines(text_reports.state_lines(report), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 5


def test_verify_counts_the_newest_snapshot_only(spark, tmp_path):
    path = str(tmp_path / "markers")
    verify_start(facts(spark, D1, ("k", "1"), ("z", "1")), path, "release")
    history = facts(spark, D2, ("k", "1"), ("z", "1")).unionByName(facts(spark, D3, ("z", "1")))
    got = verify_report(spark, "release", history, path)
    assert tuples(got.changes, "key", "kind") == [("k", "removed")]
    assert tuples(got.pairs, "b_taken") == [(D3,)]
