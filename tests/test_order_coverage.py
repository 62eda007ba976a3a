"""Numbers in a global order, coverage by bits, text reports with windows of each host."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from opsdiff.operators import dedupe
from opsdiff.operators.ordinals import with_ordinal
from opsdiff.operators.windows import Windows
from opsdiff.plans import text_reports
from opsdiff.plans.reports import compare, proc_report
from tests.helpers import A0, A1, B0, B1, WINDOWS, exchanges, samples, tuples, two_sided


@pytest.mark.parametrize("within", [None, "host"])
def test_ordinals_over_many_ranges(spark, within, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["busy"] * 5 + ["a", "b", None]), rng.randrange(50), rng.randrange(10**9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "host string, x int, y long").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = with_ordinal(df, ["x", "y"], "n", within, str(tmp_path / "o")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert df.columns == ["host", "x", "y"] and len(got) == len(rows)
    for group in {r["host"] for r in got} if within else [None]:
        mine = [r for r in got if not within or r["host"] == group]
        assert [(r["x"], r["y"]) for r in sorted(mine, key=lambda r: r["n"])] == sorted((r["x"], r["y"]) for r in mine)
        assert sorted(r["n"] for r in mine) == list(range(1, len(mine) + 1))
    assert spark.read.parquet(str(tmp_path / "o")).select("_range").distinct().count() > 1


def test_ordinals_of_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "host string, x int")
    assert with_ordinal(none, ["x"], "n", path=str(tmp_path / "a")).count() == 0
    assert with_ordinal(none, ["x"], "n", "host", path=str(tmp_path / "b")).count() == 0


def test_coverage_over_several_words(spark):
    names = [f"m{k:03}" for k in range(200)]
    wanted = spark.createDataFrame([(n,) for n in names] * 2, "metric string")
    has = {"all": names, "some": names[::3] + ["other"], "edge": [names[63], names[64], names[127], names[128], names[199]], "none": ["other"]}
    rows = [(h, "10:00", m, "", 1.0) for h, ms in has.items() for m in ms for _ in range(2)]
    got = dedupe.missing_metrics(samples(spark, rows), wanted)
    assert set(tuples(got, "host", "metric")) == {(h, m) for h, ms in has.items() for m in set(names) - set(ms)}
    hosts = spark.createDataFrame([("edge",), ("silent",)], "host string")
    got = dedupe.missing_metrics(samples(spark, rows), wanted, hosts)
    assert set(tuples(got, "host", "metric")) == {("edge", m) for m in set(names) - set(has["edge"])} | {("silent", m) for m in names}
    assert dedupe.missing_metrics(samples(spark, rows), wanted.limit(0)).count() == 0
    assert dedupe.missing_metrics(samples(spark, []), wanted).count() == 0


def test_coverage_makes_no_row_per_host_and_metric(spark):
    wanted = spark.createDataFrame([(f"m{k}",) for k in range(200)], "metric string")
    rows = spark.range(1000).select(F.concat(F.lit("h"), F.col("id") % 5).alias("host"), F.concat(F.lit("m"), F.col("id") % 150).alias("metric"))
    got = dedupe.missing_metrics(rows, wanted)
    assert exchanges(got, "metric") == 0 and exchanges(got, "word") == 1


def own_windows(spark, *rows):
    return spark.createDataFrame(rows, "host string, a_start timestamp_ntz, a_end timestamp_ntz, b_start timestamp_ntz, b_end timestamp_ntz, threshold_pct double")


def test_text_reports_with_windows_of_each_host(spark):
    data = two_sided(spark, [("h", "kernel.all.load", "", 1, 4), ("g", "kernel.all.load", "", 1, 4)])
    later = timedelta(minutes=15)
    windows = own_windows(spark, ("h", A0, A1, B0, B1, 15.0), ("g", A0 + later, A1, B0 + later, B1, 25.0))
    whole = tuples(text_reports.diff_lines(compare(data, windows)), "host", "line")
    assert ("h", "[A 03-01 10:00 -> 11:00] vs [B 03-01 12:00 -> 13:00] · threshold 15%") in whole
    assert ("g", "[A 03-01 10:15 -> 11:00] vs [B 03-01 12:15 -> 13:00] · threshold 25%") in whole
    assert text_reports.diff_lines(compare(data, WINDOWS)).where("line like '[A 03-01 10:00 -> 11:00]%threshold 15%'").count() == 2
    process = two_sided(spark, [(h, "proc.psinfo.utime", "1 /bin/web", 1, 9) for h in "gh"])
    metric = proc_report(process, windows).rows.select("metric").distinct().count()
    lines = tuples(text_reports.proc_lines(proc_report(process, windows), B1), "host", "line")
    if metric:
        assert ("g", "  A 03-01 10:15 ~ 11:00") in lines and ("g", "  B 03-01 12:15 ~ 13:00  (threshold 25%)") in lines
        assert ("h", "  B 03-01 12:00 ~ 13:00  (threshold 15%)") in lines


def test_lines_are_numbered_per_host(spark, tmp_path):
    report = compare(two_sided(spark, [(h, "kernel.all.load", "", 1, 4) for h in "gh"]), WINDOWS)
    lines = text_reports.diff_lines(report)
    got = text_reports.numbered_lines(lines, str(tmp_path / "n")).collect()
    want = [r["line"] for r in lines.where("host = 'g'").orderBy(*text_reports.LINE_ORDER).collect()]
    assert [r["line"] for r in sorted(got, key=lambda r: r["line_no"]) if r["host"] == "g"] == want
    assert sorted(r["line_no"] for r in got if r["host"] == "h") == list(range(1, len(want) + 1))


def test_warnings_are_part_of_the_reports(spark):
    warn = lambda *rows: spark.createDataFrame(rows, "host string, seq int, warning string")
    both = [warn(("h", 1, "late"), ("h", 2, "lost"), ("h", 3, "late")), warn(("h", 1, "lost"), ("g", 2, "late"))]
    data = two_sided(spark, [("h", "kernel.all.load", "", 1, 4)])
    for report in (compare(data, WINDOWS, warnings=both), proc_report(data, WINDOWS, warnings=both)):
        assert sorted(map(tuple, report.warnings.select("host", "warning", "seen.part", "seen.seq").collect())) == [("g", "late", 1, 2), ("h", "late", 0, 1), ("h", "lost", 0, 2)]
        assert "warnings" in report.parts()
    assert compare(data, WINDOWS).warnings is None and isinstance(WINDOWS, Windows)
