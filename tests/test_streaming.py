import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from opsdiff.operators import windows
from opsdiff.session import shared_dir
from opsdiff.sources.catalog import builtin_catalog
from opsdiff.sources.rules import builtin_rules
from opsdiff.streaming import feeds, means
from tests.helpers import SAMPLE, at, samples, tuples

SNAP = "host string, taken timestamp, sections array<struct<name:string,items:array<struct<key:string,value:string,note:string>>>>"


class Feed:
    """A folder that a stream reads, one file per batch."""

    def __init__(self, spark, schema):
        self.spark, self.schema = spark, schema
        self.path, self.out, self.state = (shared_dir(spark, n) for n in ("in", "out", "state"))
        spark.createDataFrame([], schema).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def run(self, df):
        return means.run_available(df, self.out, self.state)


def test_closed_windows_equal_batch_and_late_data_drops(spark):
    feed = Feed(spark, SAMPLE)
    stream = means.streaming_means(feed.stream(), "10 minutes", late="5 minutes")
    row = lambda t, v: ("h", at(t), "m", "", v, "u")
    feed.put([row("10:01", 1.0), row("10:09", 3.0), row("10:12", 5.0)])
    assert feed.run(stream).count() == 0
    feed.put([row("10:40", 9.0), row("10:15", 7.0)])
    assert tuples(feed.run(stream), "start", "val") == [(at("10:00"), 2.0), (at("10:10"), 6.0)]
    # the watermark is at 10:35 now: this one comes too late
    feed.put([row("10:05", 100.0), row("11:40", 1.0)])
    got = feed.run(stream)
    assert tuples(got, "start", "val") == [(at("10:00"), 2.0), (at("10:10"), 6.0), (at("10:40"), 9.0)]
    batch = windows.window_means(samples(spark, [("h", "10:01", "m", "", 1.0), ("h", "10:09", "m", "", 3.0)]), at("10:00"), at("10:10"))
    assert tuples(batch, "val") == [(2.0,)]


def test_watch_judges_closed_windows(spark):
    feed = Feed(spark, SAMPLE)
    load, drops = "kernel.all.load", "network.tcp.listendrops"
    base = spark.createDataFrame([("h", load, "", 1.0), ("h", drops, "", 1.0), ("h", "kernel.all.nprocs", "", 5.0), ("quiet", load, "", 1.0)],
                                 "host string, metric string, instance string, val double")
    feed.put([("h", at("10:05"), load, "", 4.0, "u"), ("h", at("10:06"), drops, "", 2.0, "u"), ("h", at("11:30"), load, "", 1.0, "u")])
    query = means.watch(feed.stream(), base, builtin_catalog(spark), builtin_rules(spark), feed.out, feed.state, "10 minutes", trigger={"availableNow": True})
    query.awaitTermination()
    rows = spark.read.parquet(f"{feed.out}/rows")
    assert tuples(rows, "host", "start", "metric", "kind") == [
        ("h", at("10:00"), "kernel.all.load", "worse"), ("h", at("10:00"), "kernel.all.nprocs", "gone"), ("h", at("10:00"), drops, "worse")]
    found = spark.read.parquet(f"{feed.out}/findings")
    assert tuples(found, "host", "id") == [("h", "accept-overflow")]


def snapshot(taken, host="h", **sections):
    return (host, at(taken), [(name, [(k, v, "") for k, v in items.items()]) for name, items in sections.items()])


@pytest.mark.parametrize("salts", [1, 5])
def test_change_feed(spark, salts):
    feed = Feed(spark, SNAP)
    stream = feeds.change_feed(feed.stream(), salts)
    feed.put([snapshot("10:00", sysctl={"a": "1", "b": "1", "c": ""}), snapshot("10:00", host="g", sysctl={"a": "1"})])
    assert feed.run(stream).count() == 0
    feed.put([snapshot("11:00", sysctl={"a": "2", "c": "", "d": "9"})])
    want = [("h", "a", "modified", "1", "2"), ("h", "b", "removed", "1", None), ("h", "d", "added", None, "9")]
    assert tuples(feed.run(stream), "host", "key", "kind", "old", "new") == want
    # older and repeated snapshots are ignored; an emptied section removes all its facts
    feed.put([snapshot("10:30", sysctl={"x": "1"}), snapshot("11:00", sysctl={"y": "1"}), snapshot("12:00", sysctl={})])
    got = tuples(feed.run(stream).where(F.hour("taken") == 12), "key", "kind", "old")
    assert got == [("a", "removed", "2"), ("c", "removed", ""), ("d", "removed", "9")]


def test_several_snapshots_in_one_batch(spark):
    feed = Feed(spark, SNAP)
    feed.put([snapshot("12:00", s={"a": "3"}), snapshot("10:00", s={"a": "1"}), snapshot("11:00", s={"a": "2"})])
    got = feed.run(feeds.change_feed(feed.stream(), 3))
    assert tuples(got, "old", "new") == [("1", "2"), ("2", "3")]


def state_of(feed, name):
    """The entries of a state variable as of the last batch."""
    return feed.spark.read.format("statestore").option("path", feed.state).option("stateVarName", name).load()


def test_sections_of_a_gone_host_leave_no_state(spark):
    feed = Feed(spark, SNAP)
    stream = feeds.change_feed(feed.stream(), salts=1, forget="2 hours")
    feed.put([snapshot("01:00", host="gone", s={"a": "1", "b": "1"}), snapshot("01:00", s={"a": "1"})])
    feed.run(stream)
    assert tuples(state_of(feed, "facts").select("key.host", "user_map_key.key"), "host", "key") == [("gone", "a"), ("gone", "b"), ("h", "a")]
    feed.put([snapshot("02:30", s={"a": "2"})])
    feed.run(stream)
    assert state_of(feed, "facts").count() == 3  # not yet two hours
    feed.put([snapshot("03:30", s={"a": "3"})])
    feed.run(stream)
    assert tuples(state_of(feed, "seen").select("key.host"), "host") == [("h",)]
    assert tuples(state_of(feed, "facts").select("key.host", "user_map_value.value"), "host", "value") == [("h", "3")]
    # back again: its first snapshot sets the state only
    feed.put([snapshot("04:00", host="gone", s={"c": "1"}), snapshot("04:00", s={"a": "3"})])
    got = feed.run(stream)
    assert tuples(got, "host", "key", "old", "new") == [("h", "a", "1", "2"), ("h", "a", "2", "3")]


def test_one_changed_fact_writes_one_entry(monkeypatch):
    """The entries are written for what changed, not for the section."""
    class Map(dict):
        writes = 0

        def iterator(self):
            return iter([((k,), (v,)) for k, v in self.items()])

        def updateValue(self, key, value):  # noqa: N802
            self.writes += 1
            self[key[0]] = value[0]

        def removeKey(self, key):  # noqa: N802
            self.writes += 1
            del self[key[0]]

    class Value:
        now = None

        def get(self):
            return self.now

        def update(self, value):
            self.now = value

    class Handle:
        timers = set()

        def getMapState(self, *_):  # noqa: N802
            return Map()

        def getValueState(self, *_):  # noqa: N802
            return Value()

        def registerTimer(self, ms):  # noqa: N802
            self.timers.add(ms)

        def deleteTimer(self, ms):  # noqa: N802
            self.timers.remove(ms)

    def deliver(minute, facts):
        frame = pd.DataFrame({"taken": [pd.Timestamp(2024, 3, 1, 10, minute)], "keys": [list(facts)], "values": [list(facts.values())]})
        return [tuple(r) for out in one.handleInputRows(("h", "s", 0), iter([frame]), None) for r in out[["key", "kind"]].itertuples(index=False)]

    one = feeds.SectionChanges()
    one.init(Handle())
    facts = {f"k{i}": "1" for i in range(200)}
    assert deliver(0, facts) == [] and one.facts.writes == 200
    assert deliver(1, facts | {"k7": "2"}) == [("k7", "modified")] and one.facts.writes == 201
    assert deliver(1, {}) == [] and deliver(0, {}) == [] and one.facts.writes == 201
    assert deliver(2, {k: v for k, v in facts.items() if k != "k9"} | {"k7": "2"}) == [("k9", "removed")] and one.facts.writes == 202
    assert len(Handle.timers) == 1 and len(one.facts) == 199


PROCESS = "host string, name string, start_time double, ts timestamp"


def test_restart_feed(spark):
    feed = Feed(spark, PROCESS)
    stream = feeds.restart_feed(feed.stream())
    now = at("10:00")
    feed.put([("h", "web", 1e6, now)] * 50 + [("h", "db", 0.0, now)])
    assert feed.run(stream).count() == 0
    feed.put([("h", "web", 1e6 + 60000, now), ("h", "db", 5e6, now)])
    assert feed.run(stream).count() == 0
    feed.put([("h", "web", 1e6 + 60000 + 60001, now), ("h", "web", 1e6, now)])
    assert tuples(feed.run(stream), "name", "start_before", "start_now") == [("web", 1e6 + 60000, 1e6 + 120001)]


def test_restarts_take_rows_and_write_what_changed():
    class Value:
        now, writes = None, 0

        def get(self):
            return self.now

        def update(self, value):
            self.now = value
            self.writes += 1

    class Handle:
        timers, calls = set(), 0

        def getValueState(self, *_):  # noqa: N802
            return Value()

        def registerTimer(self, ms):  # noqa: N802
            self.timers.add(ms)
            Handle.calls += 1

        def deleteTimer(self, ms):  # noqa: N802
            self.timers.remove(ms)
            Handle.calls += 1

    def deliver(*rows):
        return [(r.start_before, r.start_now) for r in one.handleInputRows(("h", "n"), iter([Row(start_time=s, ms=ms) for s, ms in rows]), None)]

    one = feeds.Restarts()
    one.init(Handle())
    assert deliver((1e6, 10), (3e6, 30), (2e6, 20), (2e6 + 1, None)) == [(1e6, 2e6), (2e6 + 1, 3e6)]
    assert one.last.now == (3e6, 30) and Handle.timers == {30} and (one.last.writes, Handle.calls) == (1, 1)
    assert deliver((3e6, 30), (1e6, 5)) == [] and (one.last.writes, Handle.calls) == (1, 1)
    assert deliver((3e6, 40)) == [] and one.last.now == (3e6, 40) and Handle.timers == {40}
    assert deliver((4e6, None)) == [(3e6, 4e6)] and one.last.now == (4e6, 40)


def test_processes_not_seen_leave_no_state(spark):
    feed = Feed(spark, PROCESS)
    stream = feeds.restart_feed(feed.stream(), forget="1 hour")
    feed.put([("h", "once", 1e6, at("10:00")), ("h", "web", 1e6, at("10:00"))])
    feed.run(stream)
    feed.put([("h", "web", 1e6, at("10:50"))])
    feed.run(stream)
    assert state_of(feed, "last").count() == 2
    feed.put([("h", "web", 2e6, at("11:30"))])
    assert tuples(feed.run(stream), "name") == [("web",)]
    assert tuples(state_of(feed, "last").select("key.name", "value.start"), "name", "start") == [("web", 2e6)]
    feed.put([("h", "once", 9e6, at("11:40"))])
    assert feed.run(stream).count() == 1  # a first start again


def test_facts_delivered_twice_count_once(spark):
    schema = "host string, taken timestamp_ntz, section string, key string, value string"
    feed = Feed(spark, schema)
    stream = means.deduplicated(feed.stream())
    fact = ("h", at("10:00"), "sysctl", "a", "1")
    feed.put([fact, fact, ("h", at("10:00"), "sysctl", "b", "1")])
    assert feed.run(stream).count() == 2
    feed.put([fact, ("h", at("10:10"), "sysctl", "a", "1")])
    assert tuples(feed.run(stream), "key", "taken") == [("a", at("10:00")), ("a", at("10:10")), ("b", at("10:00"))]


def test_tiers_are_made_from_the_tier_before(spark, tmp_path):
    feed, out, state = Feed(spark, SAMPLE), str(tmp_path / "out"), str(tmp_path / "state")
    row = lambda t, v, m="m": ("h", at(t), m, "", v, "u")
    run = lambda: [q.exception() for q in means.start_tiers(feed.stream(), out, state, late="1 minute", trigger={"availableNow": True})]
    feed.put([row("10:00:01", 1.0), row("10:00:09", 3.0), row("10:00:55", 8.0), row("10:04:00", 5.0), row("10:01:30", 7.0), row("10:00:02", None)])
    assert run() == [None, None, None]
    got = means.tier_means(spark, out)
    assert tuples(got.where("tier = '10 seconds'"), "start", "val") == [(at("10:00:00"), 2.0), (at("10:00:50"), 8.0), (at("10:01:30"), 7.0)]
    assert tuples(got.where("tier = '60 seconds'"), "start", "val") == [(at("10:00:00"), 4.0)]  # not a mean of means
    assert got.where("tier = '5 minutes'").count() == 0
    # The rest of the five minutes, in two more deliveries.
    feed.put([row("10:04:30", 1.0), row("10:12:00", 1.0)])
    run()
    feed.put([row("10:20:00", 1.0), row("10:30:00", 1.0)])
    run()
    got = means.tier_means(spark, out)
    minutes = [(at("10:00"), 4.0), (at("10:01"), 7.0), (at("10:04"), 3.0), (at("10:12"), 1.0)]
    assert sorted(map(tuple, got.where("tier = '60 seconds'").select("start", "val").collect())) == minutes
    assert tuples(got.where("tier = '5 minutes'"), "start", "val")[0] == (at("10:00:00"), (1 + 3 + 8 + 7 + 5 + 1) / 6)
    assert got.groupBy("tier", "start", "metric").count().where("count > 1").count() == 0
