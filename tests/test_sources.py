import json
import os
from datetime import datetime

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from opsdiff.operators import state
from opsdiff.plans.reports import state_report, stored_history, stored_state_report
from opsdiff.sources import catalog as cat
from opsdiff.sources import rules as rul
from opsdiff.sources import snapshots as snap
from opsdiff.sources.summary_text import read_summary_text
from opsdiff.sources.trend_csv import read_trend_csv
from tests.helpers import dicts, tuples

SUMMARY = """Performance metrics from host web1
 indented  1.0 none
  commencing Fri Mar 1

cpu.busy  12.500 millisec / second
cpu.load ["1 minute"]  1.5 none
cpu.load ["5 minute"]  -2 none
disk.bytes ["sda"] 1.5e3 Kbyte / second
mem.free 42
cpu.busy  99.0 millisec / second
no number here
"""


def test_summary_text(spark, tmp_path):
    path = tmp_path / "s.txt"
    path.write_text(SUMMARY)
    got = read_summary_text(spark, str(path), "web1")
    assert tuples(got, "metric", "instance", "val", "units") == sorted([
        ("cpu.busy", "", 12.5, "millisec / second"), ("cpu.busy", "", 99.0, "millisec / second"),
        ("cpu.load", "1 minute", 1.5, "none"), ("cpu.load", "5 minute", -2.0, "none"),
        ("disk.bytes", "sda", 1500.0, "Kbyte / second"), ("mem.free", "", 42.0, ""),
    ], key=repr)
    # the last of a repeated series has the greatest seq
    last = got.where("metric = 'cpu.busy'").agg(F.max_by("val", "seq")).first()[0]
    assert last == 99.0


def test_trend_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        'Time,"cpu.user","load-1 minute"\n2024-03-01 10:00:00,1.5,\n2024-03-01 10:00:10,N/A,0.5\n'
        "bad time,1,2\n2024-03-01 10:00:20,?,nan\n2024-03-01 10:00:30,7\n"
    )
    got = tuples(read_trend_csv(spark, str(path), "h").withColumn("s", F.second("bucket")), "series", "s", "value")
    assert got == sorted([
        ("cpu.user", 0, 1.5), ("load-1 minute", 0, None), ("cpu.user", 10, None), ("load-1 minute", 10, 0.5),
        ("cpu.user", 20, None), ("load-1 minute", 20, None), ("cpu.user", 30, 7.0),
    ], key=repr)


def test_trend_csv_without_series(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Time\n2024-03-01 10:00:00\n")
    with pytest.raises(ValueError):
        read_trend_csv(spark, str(path), "h")


def test_builtin_catalog(spark):
    rows = {r["metric"]: r for r in cat.builtin_rows()}
    assert len(rows) == 146
    assert [r["category"] for r in cat.builtin_rows()].count("Network") == 59
    assert len(cat.core_metrics()) == 26
    assert rows["kernel.all.load"]["min_abs"] == 0.5
    assert rows["network.icmp.inmsgs"]["threshold_pct"] == 300
    assert rows["kernel.percpu.cpu.user"]["fold"] and not rows["kernel.all.cpu.user"]["fold"]
    assert cat.builtin_catalog(spark).metrics.count() == 146
    assert cat.builtin_catalog(spark).preset("cpu").count() == 4
    assert cat.builtin_catalog(spark).presets.select("preset").distinct().count() == 8


def test_slim_catalog(spark):
    slim = cat.builtin_catalog(spark, slim=True)
    assert slim.metrics.count() == len(slim.names) == 109
    assert slim.metrics.agg(F.max("metric_idx")).first()[0] == 108
    assert "kernel.percpu.cpu.user" not in slim.names and "network.tcp.retranssegs" in slim.names


def metric(name, **extra):
    return {"metric": name, "label": name, "category": "C", "polarity": "worse_up", **extra}


def write_catalog(tmp_path, **doc):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"categories": ["C", "D"], "metrics": [metric("a.b")], **doc}, indent=2))
    return str(path)


def test_load_catalog_fills_defaults(spark, tmp_path):
    path = write_catalog(tmp_path, metrics=[
        metric("kernel.all.load", category="D"), metric("network.icmp.inmsgs", threshold_pct=5, min_abs=7),
        metric("kernel.percpu.cpu.sys"), metric("x.y", min_abs=0, threshold_pct=0),
    ])
    loaded = cat.load_catalog(spark, path)
    got = {r["metric"]: r for r in dicts(loaded.metrics)}
    assert got["kernel.all.load"]["min_abs"] == 0.5 and got["kernel.all.load"]["cat_idx"] == 1
    assert (got["network.icmp.inmsgs"]["threshold_pct"], got["network.icmp.inmsgs"]["min_abs"]) == (5.0, 7.0)
    assert got["kernel.percpu.cpu.sys"]["fold"] is True
    assert (got["x.y"]["threshold_pct"], got["x.y"]["min_abs"], got["x.y"]["fold"]) == (0.0, 0.0, False)
    assert [got[m]["metric_idx"] for m in ("kernel.all.load", "x.y")] == [0, 3]
    assert sorted(loaded.names) == sorted(got)
    # the file has no presets: the built-in ones stay
    assert loaded.presets.select("preset").distinct().count() == 8


def test_load_catalog_replaces_presets(spark, tmp_path):
    path = write_catalog(tmp_path, presets={"one": {"label": "One", "metrics": ["a.b", "c.d"]}})
    presets = cat.load_catalog(spark, path).presets
    assert tuples(presets, "preset", "label", "pos", "metric") == [("one", "One", 0, "a.b"), ("one", "One", 1, "c.d")]


@pytest.mark.parametrize("doc", [
    {"metrics": []}, {"categories": []}, {"categories": ["C", ""]},
    {"metrics": [metric("a;b")]}, {"metrics": [metric("a.b", category="Z")]},
    {"metrics": [metric("a.b", polarity="up")]}, {"metrics": [metric("a.b", threshold_pct=-1)]},
    {"metrics": [metric("a.b", threshold_pct=10001)]}, {"metrics": [metric("a.b", min_abs=-0.1)]},
    {"metrics": [{"metric": "a.b", "category": "C"}]}, {"metrics": [metric(None)]},
    {"presets": {"p": {"label": "x", "metrics": []}}}, {"presets": {"p": {"label": "x", "metrics": ["1;"]}}},
    {"presets": {"p": {"label": "x"}}},
])
def test_load_catalog_rejects(spark, tmp_path, doc):
    with pytest.raises(ValueError):
        cat.load_catalog(spark, write_catalog(tmp_path, **doc))


def test_malformed_json_is_rejected(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"categories": ["C"], "metrics": [')
    with pytest.raises(Exception):
        cat.load_catalog(spark, str(path))
    path.write_text("[]")
    with pytest.raises(ValueError):
        rul.load_rules(spark, str(path))


def test_catalog_round_trip(spark, tmp_path):
    builtin = cat.builtin_catalog(spark)
    cat.export_catalog(builtin, str(tmp_path / "out"))
    loaded = cat.load_catalog(spark, str(tmp_path / "out" / "part-*"))
    key = lambda c: tuples(c.metrics, *sorted(builtin.metrics.columns))
    assert key(loaded) == key(builtin)
    assert tuples(loaded.presets, "preset", "pos", "metric") == tuples(builtin.presets, "preset", "pos", "metric")


def rule(name="r", **extra):
    return {"id": name, "severity": "warn", "conclusion": "c", "when": [{"metric": "a.b", "verdict": "worse"}], **extra}


def write_rules(tmp_path, *rules):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rules, indent=1))
    return str(path)


def test_rules_round_trip(spark, tmp_path):
    builtin = rul.builtin_rules(spark)
    assert builtin.heads.count() == 16
    assert dict(tuples(builtin.heads.groupBy("severity").count(), "severity", "count")) == {"crit": 7, "warn": 8, "info": 1}
    rul.export_rules(builtin, str(tmp_path / "out"))
    loaded = rul.load_rules(spark, str(tmp_path / "out" / "part-*"))
    norm = lambda r: tuples(
        r.conditions.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in builtin.conditions.columns])
        .replace("false", ""), *builtin.conditions.columns)
    assert norm(loaded) == norm(builtin)
    assert tuples(loaded.heads, "rule_idx", "id", "next") == tuples(builtin.heads, "rule_idx", "id", "next")


@pytest.mark.parametrize("rules", [
    [rule(""), ], [rule(conclusion="")], [rule(when=[])], [rule("x"), rule("x")], [rule(severity="fatal")],
    [rule(when=[{"metric": "a b"}])], [rule(when=[{"metric": "a.b", "verdict": "bad"}])],
    [{"id": "x", "severity": "warn", "conclusion": "c"}],
])
def test_load_rules_rejects(spark, tmp_path, rules):
    with pytest.raises(ValueError):
        rul.load_rules(spark, write_rules(tmp_path, *rules))


FACT = "host string, taken timestamp_ntz, section string, key string, value string"


def facts(spark, taken, *pairs, host="h"):
    return spark.createDataFrame([(host, taken, "sysctl", k, v) for k, v in pairs], FACT)


def test_snapshots_are_appended_and_cut_to_seconds(spark, tmp_path):
    path = str(tmp_path / "facts")
    for day in (1, 2):
        snap.write_snapshot(facts(spark, datetime(2024, 3, day, 1, 2, 3, 456789), ("a", str(day))), path)
    got = tuples(snap.read_facts(spark, path).withColumn("d", F.col("date").cast("string")), "taken", "value", "d")
    assert got == [(datetime(2024, 3, 1, 1, 2, 3), "1", "2024-03-01"), (datetime(2024, 3, 2, 1, 2, 3), "2", "2024-03-02")]


def test_markers_replace_by_name(spark, tmp_path):
    path = str(tmp_path / "markers")
    t = datetime(2024, 3, 1)
    with pytest.raises(ValueError):
        snap.load_marker(spark, "rel", path)
    snap.save_marker("rel", facts(spark, t, ("a", "1")), path)
    snap.save_marker("other", facts(spark, t, ("a", "2")), path)
    snap.save_marker("rel", facts(spark, t, ("a", "3"), ("b", "4")), path)
    assert tuples(snap.load_marker(spark, "rel", path), "key", "value") == [("a", "3"), ("b", "4")]
    assert tuples(snap.load_marker(spark, "other", path), "value") == [("2",)]
    with pytest.raises(ValueError):
        snap.load_marker(spark, "none", path)


def test_expired_days_are_dropped(spark, tmp_path):
    path = str(tmp_path / "facts")
    for day in range(1, 6):
        snap.write_snapshot(facts(spark, datetime(2024, 3, day, 12), ("a", str(day))), path)
    dropped = snap.drop_expired_days(spark, path, datetime(2024, 3, 10, 6), keep_days=7)
    assert dropped == ["date=2024-03-01", "date=2024-03-02"]
    from opsdiff.operators.state import retained
    kept = retained(snap.read_facts(spark, path), datetime(2024, 3, 10, 18), keep_days=7)
    assert tuples(kept, "value") == [("4",), ("5",)]
    kept = retained(snap.read_facts(spark, path), datetime(2024, 3, 10, 12), keep_days=7)
    assert tuples(kept, "value") == [("3",), ("4",), ("5",)]


def test_snapshot_json(spark, tmp_path):
    body = {"host": "h", "taken": "2024-03-01T10:00:00Z", "sections": [
        {"name": "sysctl", "title": "T", "items": [{"key": "a", "value": "1"}, {"key": "b", "value": "", "note": "n"}]},
        {"name": "modules", "title": "M", "items": [], "skipped": "why"},
    ]}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(body) + "\nnot json\n")
    parsed = snap.read_snapshots(spark, str(path))
    assert tuples(snap.explode_snapshot(parsed), "section", "title", "key", "value", "note", "seq") == [
        ("sysctl", "T", "a", "1", "", 0), ("sysctl", "T", "b", "", "n", 1)]
    assert tuples(snap.explode_sections(parsed), "section", "skipped") == [("modules", "why"), ("sysctl", "")]


def test_every_csv_file_has_its_own_header_and_host(spark, tmp_path):
    (tmp_path / "web1.csv").write_text('Time,m.a,"m.b"\n2024-03-01 10:00:00,1,2\n2024-03-01 10:01:00,,5,9\n')
    (tmp_path / "web2.csv").write_text("Time,m.c,m.a\n2024-03-01 10:00:00,3,4\n2024-03-01 10:01:00,7\n")
    got = tuples(read_trend_csv(spark, str(tmp_path), host_pattern=r"([^/]+)\.csv$").withColumn("m", F.minute("bucket")), "host", "series", "m", "value")
    assert got == sorted([
        ("web1", "m.a", 0, 1.0), ("web1", "m.b", 0, 2.0), ("web1", "m.a", 1, None), ("web1", "m.b", 1, 5.0),
        ("web2", "m.c", 0, 3.0), ("web2", "m.a", 0, 4.0), ("web2", "m.c", 1, 7.0),
    ], key=repr)
    with pytest.raises(ValueError):
        read_trend_csv(spark, str(tmp_path))


def test_markers_do_not_mix_and_are_replaced_by_none(spark, tmp_path):
    path, t = str(tmp_path / "markers"), datetime(2024, 1, 1)
    for name, value in (("7", "1"), ("007", "2"), ("a/b", "3")):
        snap.save_marker(name, facts(spark, t, ("k", value)), path)
    assert [tuples(snap.load_marker(spark, n, path), "value") for n in ("7", "007", "a/b")] == [[("1",)], [("2",)], [("3",)]]
    snap.save_marker("7", facts(spark, t, ("k", "1")).limit(0), path)
    assert snap.load_marker(spark, "7", path).count() == 0
    assert tuples(snap.load_marker(spark, "007", path), "value") == [("2",)]


def test_no_body_is_lost(spark):
    bodies = spark.createDataFrame([('{"host":"h","taken":"2024-01-01T00:00:00Z","sections":[]}', 1), ("{broken", 2), ("[]", 3), (None, 4)], "value string, n int")
    assert snap.parse_snapshots(bodies).count() == 1
    assert tuples(snap.rejected_bodies(bodies), "n") == [(2,), (3,), (4,)]


def test_summary_files_of_a_fleet(spark, tmp_path):
    for name, lines in (("web1.0.txt", "cpu.busy 1.0 none\ncpu.busy 2.0 none\n"), ("web1.1.txt", "cpu.busy 3.0 none\n"), ("web2.0.txt", "cpu.busy 9.0 none\n")):
        (tmp_path / name).write_text(lines)
    got = read_summary_text(spark, str(tmp_path), host_pattern=r"([^/.]+)\.\d+\.txt$")
    assert tuples(got.groupBy("host").agg(F.max_by("val", "seq").alias("last")), "host", "last") == [("web1", 3.0), ("web2", 9.0)]


def test_an_empty_snapshot_is_stored_and_found(spark, tmp_path):
    bodies = [
        '{"host":"h","taken":"2024-01-01T00:00:00Z","sections":[{"name":"sysctl","title":"T","items":[{"key":"k","value":"1"}]}]}',
        '{"host":"h","taken":"2024-01-02T00:00:00Z","sections":[]}',
        '{"host":"h","taken":"2024-01-03T00:00:00Z","sections":[{"name":"listen","title":"L","items":[],"skipped":"no ss"}]}',
    ]
    snap.write_snapshots(snap.parse_snapshots(spark.createDataFrame([(b,) for b in bodies], "value string")), str(tmp_path / "s"))
    headers, sections, stored = (snap.read_snapshot_table(spark, str(tmp_path / "s"), n) for n in ("headers", "sections", "facts"))
    assert headers.count() == 3 and stored.count() == 1
    assert tuples(sections, "section", "title", "skipped") == [("listen", "L", "no ss"), ("sysctl", "T", "")]
    asof = state.snapshot_asof(headers, datetime(2024, 1, 2, 12))
    assert tuples(asof, "taken") == [(datetime(2024, 1, 2),)]
    report = state_report(stored, datetime(2024, 1, 1), datetime(2024, 1, 2), headers=headers)
    assert tuples(report.changes, "key", "kind") == [("k", "removed")]


class Stopped(Exception):
    pass


@pytest.mark.parametrize("after", [0, 1, 2, 3])
def test_a_batch_is_there_whole_or_not_at_all(spark, tmp_path, monkeypatch, after):
    path, days = str(tmp_path / "s"), [datetime(2024, 1, d) for d in (1, 2)]
    flat = lambda t, v: facts(spark, t, ("k", v)).withColumns({"title": F.lit("T"), "note": F.lit(""), "seq": F.lit(0)})
    snap.write_flat_snapshots(flat(days[0], "1"), path, "one")
    real, written = DataFrameWriter.parquet, []

    def stops(self, to, *args, **kw):
        if len(written) == after:
            raise Stopped
        written.append(to)
        return real(self, to, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", stops)
    with pytest.raises(Stopped):
        snap.write_flat_snapshots(flat(days[1], "2"), path, "two")
    monkeypatch.undo()
    assert len(written) == after
    count = lambda: [snap.read_snapshot_table(spark, path, n).count() for n in snap.TABLES]
    assert count() == [1, 1, 1]
    assert stored_history(spark, path).count() == 0
    # The same batch again, and once more after it is committed.
    snap.write_flat_snapshots(flat(days[1], "2"), path, "two")
    snap.write_flat_snapshots(flat(days[1], "3"), path, "two")
    assert count() == [2, 2, 2]
    assert tuples(stored_history(spark, path), "key", "old", "new", "title") == [("k", "1", "2", "T")]
    assert tuples(stored_state_report(spark, path).changes, "old", "new") == [("1", "2")]
    assert snap.drop_uncommitted(spark, path) == after and count() == [2, 2, 2]


def test_nothing_stored_and_first_batch_lost(spark, tmp_path):
    with pytest.raises(ValueError):
        snap.read_snapshot_table(spark, str(tmp_path / "none"), "facts")
    with pytest.raises(ValueError):
        snap.read_snapshot_table(spark, str(tmp_path / "none"), "other")


def test_a_baseline_stays_when_its_replacement_fails(spark, tmp_path, monkeypatch):
    path, t = str(tmp_path / "markers"), datetime(2024, 1, 1)
    value = lambda: tuples(snap.load_marker(spark, "rel", path), "value")
    snap.save_marker("rel", facts(spark, t, ("k", "1")), path)
    broken = facts(spark, t, ("k", "2")).withColumn("value", F.raise_error(F.lit("disk full")))
    with pytest.raises(Exception, match="disk full"):
        snap.save_marker("rel", broken, path)
    assert value() == [("1",)]
    monkeypatch.setattr(snap, "_commit", lambda *_: (_ for _ in ()).throw(Stopped()))
    with pytest.raises(Stopped):
        snap.save_marker("rel", facts(spark, t, ("k", "3")), path)
    monkeypatch.undo()
    assert value() == [("1",)]
    before = snap.load_marker(spark, "rel", path)
    snap.save_marker("rel", facts(spark, t, ("k", "4")), path)
    assert value() == [("4",)] and tuples(before, "value") == [("1",)]  # a reader that began before
    for n in range(5, 9):
        snap.save_marker("rel", facts(spark, t, ("k", str(n))), path)
    kept = os.listdir(tmp_path / "markers" / "rel.marker" / "versions")
    assert value() == [("8",)] and len(kept) <= 4  # two versions, and what failed
