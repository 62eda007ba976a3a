from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsdiff.operators import trend
from opsdiff.sources.catalog import builtin_catalog
from tests.helpers import A0, A1, SAMPLE, dicts, samples, tuples

T0 = datetime(2024, 3, 1, 10, 0, 7)


def test_step():
    step = lambda **span: trend.trend_step(T0, T0 + timedelta(**span)).total_seconds()
    assert [step(hours=1), step(days=14), step(hours=24), step(seconds=6300), step(seconds=6299)] == [10, 900, 144, 11, 10]


def test_step_column(spark):
    spans = [3600, 14 * 86400, 86400, 6300, 6299]
    df = spark.createDataFrame([(T0, T0 + timedelta(seconds=s)) for s in spans], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(trend.trend_step_seconds(F.col("a"), F.col("b"))).collect()] == [10, 900, 144, 11, 10]


def test_buckets_are_aligned_to_the_window(spark):
    data = samples(spark, [("h", "10:00:07", "m", "", 1.0), ("h", "10:00:16.9", "m", "", 3.0), ("h", "10:00:17", "m", "", 5.0), ("h", "10:00:06", "m", "", 9.0)])
    got = trend.trend(data, ["m"], T0, T0 + timedelta(hours=1))
    assert set(tuples(got, "bucket", "value")) == {(T0, 2.0), (T0 + timedelta(seconds=10), 5.0)}
    last = trend.trend(data, ["m"], T0, T0 + timedelta(hours=1), how="last")
    assert tuples(last, "value") == [(3.0,), (5.0,)]
    with pytest.raises(ValueError):
        trend.trend(data, ["m"], T0, T0)
    with pytest.raises(ValueError):
        trend.trend(data, ["m"], T0, T0 + timedelta(hours=1), how="max")


def test_gaps_stay_gaps(spark):
    data = samples(spark, [("h", "10:00:10", "m", "", 1.0), ("h", "10:00:40", "m", "", 4.0), ("h", "10:00:00", "m", "b", 1.0)])
    start, end, step = A0, A0 + timedelta(seconds=55), timedelta(seconds=10)
    points = trend.trend(data, ["m"], start, end, step)
    got = trend.fill_grid(points, start, end, step)
    sec = lambda r: int((r["bucket"] - A0).total_seconds())
    one = {sec(r): r["value"] for r in dicts(got.where("instance = ''"))}
    assert one == {0: None, 10: 1.0, 20: None, 30: None, 40: 4.0, 50: None}
    assert {sec(r): r["value"] for r in dicts(got.where("instance = 'b'"))} == {0: 1.0, 10: None, 20: None, 30: None, 40: None, 50: None}


def test_overlay(spark):
    rows = [
        ("h", datetime(2024, 3, 2, 10, 5), "m", "", 7.0, "u"), ("h", datetime(2024, 3, 1, 10, 5), "m", "", 5.0, "u"),
        ("h", datetime(2024, 3, 1, 10, 25), "m", "", 6.0, "u"), ("h", datetime(2024, 3, 1, 10, 25), "x", "", 6.0, "u"),
    ]
    got = trend.overlay(spark.createDataFrame(rows, SAMPLE), ["m"], datetime(2024, 3, 2, 10), datetime(2024, 3, 2, 11), step=timedelta(minutes=10))
    assert tuples(got, "bucket", "value", "earlier") == [(datetime(2024, 3, 2, 10), 7.0, 5.0), (datetime(2024, 3, 2, 10, 20), None, 6.0)]
    # windows longer than the shift: a sample counts on both days
    long = trend.overlay(spark.createDataFrame(rows, SAMPLE), ["m"], datetime(2024, 3, 1), datetime(2024, 3, 3), step=timedelta(days=1))
    assert tuples(long, "bucket", "value", "earlier") == [(datetime(2024, 3, 1), 5.5, None), (datetime(2024, 3, 2), 7.0, 5.5)]


def test_series_and_wide(spark):
    data = samples(spark, [("h", "10:00:20", "m", "a", 2.0), ("h", "10:00:00", "m", "a", 1.0), ("h", "10:00:00", "n", "", 3.0)])
    points = trend.trend(data, ["m", "n"], A0, A1)
    ms = int(A0.timestamp() * 1000)
    series = {r["series"]: [tuple(p.values()) for p in r["points"]] for r in dicts(trend.as_series(points))}
    assert series == {"m-a": [(ms, 1.0), (ms + 20000, 2.0)], "n": [(ms, 3.0)]}
    wide = trend.trend_wide(points, ["m-a", "n"])
    assert tuples(wide, "`m-a`", "n") == [(1.0, 3.0), (2.0, None)]


def test_missing_metrics(spark):
    preset = builtin_catalog(spark).preset("disk")
    data = samples(spark, [("h", "10:30", "disk.all.read_bytes", "", 1.0), ("g", "09:30", "disk.all.write_bytes", "", 1.0), ("g", "10:30", "z", "", 1.0)])
    assert tuples(trend.trend_missing(data, preset, A0, A1), "host", "metric") == [
        ("g", "disk.all.read_bytes"), ("g", "disk.all.write_bytes"), ("h", "disk.all.write_bytes")]
    trend.require_any(data, preset, A0, A1)
    with pytest.raises(ValueError):
        trend.require_any(data, builtin_catalog(spark).preset("cpu"), A0, A1)


def test_long_list_of_names_is_joined(spark, monkeypatch):
    from opsdiff.sources import catalog
    monkeypatch.setattr(catalog, "MAX_IN_LIST", 1)
    data = samples(spark, [("h", "10:30", "kernel.all.cpu.user", "", 1.0), ("h", "10:30", "z", "", 1.0)])
    assert trend.trend(data, builtin_catalog(spark).preset("cpu"), A0, A1).count() == 1
