import pytest
from pyspark.sql import functions as F

from opsdiff.functions import judge as j
from opsdiff.functions import text as t

CASES = [
    # a, b, polarity, threshold, floor -> delta, exceeded, verdict
    (200.0, 900.0, "worse_up", 15, 0, 350.0, True, "worse"),
    (200.0, 100.0, "worse_up", 15, 0, -50.0, True, "better"),
    (800.0, 200.0, "better_up", 15, 0, -75.0, True, "worse"),
    (800.0, 1000.0, "better_up", 15, 0, 25.0, True, "better"),
    (50.0, 150.0, "neutral", 15, 0, 200.0, True, "watch"),
    (50.0, 54.0, "worse_up", 15, 0, 8.0, False, "flat"),
    (0.0, 0.0, "worse_up", 15, 0, 0.0, False, "flat"),
    (0.0, 3.0, "worse_up", 15, 0, None, True, "worse"),
    (0.0, 3.0, "better_up", 15, 0, None, True, "better"),
    (0.0, -3.0, "worse_up", 15, 0, None, True, "better"),
    (None, 3.0, "worse_up", 15, 0, None, True, "watch"),
    (3.0, None, "better_up", 15, 0, None, True, "watch"),
    (None, None, "worse_up", 15, 0, None, True, "watch"),
    # the threshold is inclusive
    (100.0, 115.0, "worse_up", 15, 0, 15.0, True, "worse"),
    # floor: both sides below it are flat whatever the ratio
    (0.004, 0.09, "worse_up", 15, 1, 2150.0, False, "flat"),
    (300.0, 500.0, "worse_up", 15, 51200, 66.66666666666667, False, "flat"),
    (0.0, 0.5, "worse_up", 15, 1, None, False, "flat"),
    (0.5, 0.5, "worse_up", 15, 1, 0.0, False, "flat"),
    (400.0, 2000.0, "worse_up", 15, 10, 400.0, True, "worse"),
    (0.5, 90.0, "worse_up", 15, 10, 17900.0, True, "worse"),
    (0.5, 1.0, "worse_up", 15, 1, 100.0, True, "worse"),  # exactly on the floor counts
    # negative baseline: the change is relative to its size
    (-10.0, -5.0, "worse_up", 15, 0, 50.0, True, "worse"),
    (10.0, 0.0, "worse_up", 15, 0, -100.0, True, "better"),
    # threshold 0 and no change: exceeded and not up
    (7.0, 7.0, "worse_up", 0, 0, 0.0, True, "better"),
    (7.0, 7.0, "better_up", 0, 0, 0.0, True, "worse"),
]


def test_judge_table(spark):
    df = spark.createDataFrame(
        [(i, *c[:3], float(c[3]), float(c[4])) for i, c in enumerate(CASES)],
        "i int, a double, b double, pol string, thr double, floor double",
    )
    c = F.col
    got = df.select("i", j.judge(c("a"), c("b"), c("pol"), c("thr"), c("floor")).alias("j")).select("i", "j.*")
    for row in got.collect():
        want = CASES[row.i][5:]
        assert (row.exceeded, row.verdict) == want[1:], CASES[row.i]
        assert row.delta_pct == (want[0] if want[0] is None else pytest.approx(want[0])), CASES[row.i]


def test_judge_proc(spark):
    cases = [
        (400.0, 8000.0, 1900.0, "worse"), (100.0, 50.0, -50.0, "better"), (None, 5.0, None, "appeared"),
        (5.0, None, None, "gone"), (None, None, None, "flat"), (0.0, 0.0, 0.0, "flat"),
        (0.0, 1.0, None, "worse"), (100.0, 119.0, 19.0, "flat"), (100.0, 120.0, 20.0, "worse"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], "i int, a double, b double")
    got = df.select("i", j.judge_proc(F.col("a"), F.col("b"), F.lit(20.0)).alias("j")).select("i", "j.*").collect()
    assert {r.i: (r.delta_pct, r.verdict) for r in got} == {i: c[2:] for i, c in enumerate(cases)}


def test_restart_needs_more_than_a_minute(spark):
    df = spark.createDataFrame(
        [(1e6, 1e6 + 60000), (1e6, 1e6 + 60001), (0.0, 1e9), (None, 1e9)], "a double, b double"
    )
    got = [r[0] for r in df.select(j.restarted(F.col("a"), F.col("b"))).collect()]
    assert got == [False, True, False, False]


def test_weights_of_undefined_change(spark):
    df = spark.createDataFrame([(None, 0.0, 5.0), (None, None, 5.0), (-30.0, 10.0, 7.0)], "d double, a double, b double")
    c = F.col
    got = df.select(j.triage_weight(c("d")), j.display_weight(c("d"), c("a"), c("b"))).collect()
    assert [tuple(r) for r in got] == [(1e18, 0.0), (1e18, float("inf")), (30.0, 30.0)]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_proc_name(spark):
    cases = {
        "77 postgres": "postgres", "0077 /usr/lib/x/redis-server": "redis-server", "77": "", "": "",
        "  12\tcron -f ": "cron", "kthreadd": "kthreadd", "-5": "", "/usr/bin/solo": "/usr/bin/solo",
        "99999999999999999999999": "99999999999999999999999", "7 /ends/": "",
    }
    for text, want in cases.items():
        assert one(spark, t.proc_name(F.lit(text))) == want, text


def test_formats_round_the_exact_value(spark):
    assert one(spark, t.fmt_val(F.lit(1.005))) == "1.00"
    assert one(spark, t.fmt_val(F.lit(0.125))) == "0.12"
    cases = {0.0: "0", 9999.0: "9999.00", 10000.0: "10.00k", 2.5e6: "2.50M", -3e9: "-3.00G"}
    for x, want in cases.items():
        assert one(spark, t.fmt_val(F.lit(x))) == want
    assert one(spark, t.fmt_val(F.lit(None).cast("double"))) == "—"


def test_fmt_num(spark):
    cases = {
        0.0: "0", 123.25: "123.3", 5.125: "5.13", 1.005: "1.00", 0.5: "0.500", 0.01234: "0.0123",
        0.9996: "1.00", 0.0000012345: "0.00000123", 0.00000012345: "1.23e-7", -0.25: "-0.250",
        45678.0: "45.68k", 1e6: "1.00M", -2e9: "-2.00G",
        2208.5 / 7e11: "3.15e-9", 0.03125: "0.0313", -0.00390625: "-0.00391", 9.9999e-5: "0.000100", 9.9999e-8: "1.00e-7",
        9.9949e-7: "9.99e-7", 1e-6: "0.00000100", 5e-324: "4.94e-324", 2.2250738585072014e-308: "2.23e-308", 0.1 + 0.2: "0.300",
    }
    for x, want in cases.items():
        assert one(spark, t.fmt_num(F.lit(x))) == want, x


def test_fmt_num_ties_to_even(spark):
    cases = {
        -89.625: "-89.62", 89.635: "89.64", 1291.25: "1291.2", 1291.75: "1291.8", 10125000.0: "10.12M", 0.03125: "0.0312", 0.09375: "0.0938",
        -0.1875: "-0.188", 0.0625: "0.0625", 62737.5 * (-1 / 7e2): "-89.62", 0.0: "0", 0.9996: "1.00", 1e-322: "9.88e-323", 3.95e-321: "3.95e-321",
    }
    got = spark.createDataFrame([(x,) for x in cases], "x double").select("x", t.fmt_num(F.col("x"), half_up=False).alias("text"))
    assert dict(map(tuple, got.collect())) == cases


def test_fmt_num_of_the_smallest_numbers(spark):
    sizes = [k * 5e-324 for k in (*range(1, 300), 999, 1001, 2025, 8000, 8095, 8096, 8100, 8192, 20000)]
    got = spark.createDataFrame([(x,) for x in sizes], "x double").select("x", t.fmt_num(F.col("x")).alias("text"))
    assert {x: text for x, text in got.collect()} == {x: f"{x:.2e}" for x in sizes}


def test_evidence_headline_and_delta(spark):
    n = F.lit(None).cast("double")
    line = lambda inst, a, b, d: one(spark, t.evidence_line(F.lit("m.x"), F.lit(inst), a, b, d))
    assert line("sda", F.lit(1.0), F.lit(2.0), F.lit(100.04)) == "m.x[sda] Δ+100.0%"
    assert line("", F.lit(1.0), F.lit(0.5), F.lit(-50.06)) == "m.x Δ-50.1%"
    assert line("", n, F.lit(2.0), n) == "m.x (new)"
    assert line("", F.lit(2.0), n, n) == "m.x (gone)"
    assert line("", F.lit(0.0), F.lit(2.0), n) == "m.x"
    head = lambda a, b, d: one(spark, t.headline(F.lit("Load"), F.lit("1"), a, b, d))
    assert head(F.lit(1.0), F.lit(2.0), F.lit(99.99)) == "Load[1] +99%"
    assert head(F.lit(1.0), F.lit(2.0), F.lit(-0.7)) == "Load[1] 0%"
    assert head(F.lit(1.0), F.lit(2.0), F.lit(1000.0)) == "Load[1] +spike"
    assert head(F.lit(1.0), F.lit(2.0), F.lit(-1000.0)) == "Load[1] spike"
    assert head(n, F.lit(2.0), n) == "Load[1] appeared"
    assert head(F.lit(0.0), F.lit(2.0), n) == "Load[1] anomaly"
    delta = lambda kind, d: one(spark, t.delta_text(F.lit(kind), d))
    assert [delta("new", n), delta("gone", n), delta("worse", n), delta("worse", F.lit(7.25))] == ["⊕", "⊖", "∞", "+7.2%"]


def test_small_text_functions(spark):
    ago = [one(spark, t.ago_text(F.lit(float(ms)))) for ms in (-5, 59999, 60000, 7199999, 86400000 * 3.9)]
    assert ago == ["just now", "just now", "1m ago", "1h ago", "3d ago"]
    assert one(spark, t.md_escape(F.lit("a|b`c"))) == "a b c"
    assert one(spark, t.md_escape(F.lit("x" * 60))) == "x" * 60
    assert one(spark, t.md_escape(F.lit("x" * 61))) == "x" * 57 + "..."
    assert one(spark, t.md_escape(F.lit("é" * 31))) == "é" * 28 + "�..."
    assert one(spark, t.first_quoted(F.lit('users:(("sshd",pid=1),("x"'))) == "sshd"
    assert one(spark, t.first_quoted(F.lit('only " one'))) == ""
    assert one(spark, t.clean_lines(F.lit(" a \r\n\n\t\n b "))) == ["a", "b"]
    assert [one(spark, t.valid_metric(F.lit(m))) for m in ("a.b_1", "1a", "a;b", "")] == [True, False, False, False]


def test_parse_when(spark):
    good = ["2024-05-06T07:08:09", "2024-05-06T07:08", "2024-05-06 07:08:09", "2024-05-06 07:08"]
    assert all(one(spark, t.parse_when(F.lit(s))) is not None for s in good)
    for s in ["2024-05-06", "06.05.2024 07:08", "2024-13-06 07:08", "2024-02-30 07:08", "", "x"]:
        assert one(spark, t.parse_when(F.lit(s))) is None, s


def test_parse_duration(spark):
    assert t.parse_duration("1h30m").total_seconds() == 5400
    assert t.parse_duration("0.5h").total_seconds() == 1800
    for bad in ["", "0h", "-1h", "5", "h", "1d"]:
        with pytest.raises(ValueError):
            t.parse_duration(bad)
        assert one(spark, t.duration_seconds(F.lit(bad))) is None
    assert one(spark, t.duration_seconds(F.lit("168h"))) == 604800.0
