"""Stateful feeds: changes of state from snapshot to snapshot, and process restarts.

What to emit depends on the last complete map of a section, or the last start of a process, which no
built-in aggregate keeps.  Each key has entries of its own in the state store: a change writes
the facts that changed and nothing else.  Event-time timers clear what has not been
delivered for a while, so that hosts and processes that are gone leave no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsdiff.functions.judge import RESTART_GAP_MS

CHANGE = "host string, section string, taken timestamp, key string, kind string, old string, new string"
RESTART = "host string, name string, start_before double, start_now double"
FORGET = "40 days"


def salted_sections(snapshots: DataFrame, salts: int) -> DataFrame:
    """One row per snapshot, section and salt, with that salt's share of the facts.

    Every salt gets a row from every snapshot, also an empty one, so that each
    share sees removals; the facts of a large section are spread over many keys.
    """
    sections = snapshots.select("host", "taken", F.inline("sections"))
    share = F.filter("items", lambda item: F.pmod(F.xxhash64(item["key"]), F.lit(salts)) == F.col("salt"))
    return sections.select(
        "host", "taken", F.col("name").alias("section"), "items",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    ).select(
        "host", "section", "salt", "taken",
        F.transform(share, lambda i: i["key"]).alias("keys"),
        F.transform(share, lambda i: F.coalesce(i["value"], F.lit(""))).alias("values"),
    )


class SectionChanges(StatefulProcessor):
    """State of one share of one section: its facts, one entry each, and the time of the last snapshot."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getMapState("facts", "key string", "value string")
        self.seen = handle.getValueState("seen", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        host, section, _ = key
        first = self.seen.get()
        last = first[0] if first is not None else None
        # The state is read once for all snapshots that arrived; what changed is written at the end.
        before = {k[0]: v[0] for k, v in self.facts.iterator()} if last is not None else {}
        known = dict(before)
        for row in pd.concat(rows).sort_values("taken", kind="stable").itertuples(index=False):
            us = row.taken.value // 1000
            if last is not None and us <= last:
                continue
            facts = dict(zip(row.keys, row.values))
            if last is not None:
                changes = [
                    (k, "added" if k not in known else "modified", known.get(k), value)
                    for k, value in facts.items() if k not in known or known[k] != value
                ] + [(k, "removed", known[k], None) for k in known if k not in facts]
                if changes:
                    out = pd.DataFrame(changes, columns=["key", "kind", "old", "new"])
                    yield out.assign(host=host, section=section, taken=row.taken)[
                        ["host", "section", "taken", "key", "kind", "old", "new"]
                    ]
            known, last = facts, us
        if last is None or (first is not None and first[0] == last):
            return
        for k, value in known.items():
            if before.get(k) != value:
                self.facts.updateValue((k,), (value,))
        for k in before.keys() - known.keys():
            self.facts.removeKey((k,))
        self.seen.update((last,))
        # The watermark lies a period behind the newest snapshot: it passes this one when nothing followed for so long.
        if first is not None:
            self.handle.deleteTimer(first[0] // 1000)
        self.handle.registerTimer(last // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.facts.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def change_feed(snapshots: DataFrame, salts: int = 8, forget: str = FORGET) -> DataFrame:
    """Changes from each snapshot to the next, as snapshots(host, taken, sections) arrive.

    A snapshot row carries whole sections, so a section is never compared half delivered.  A
    snapshot not newer than the last one of its section is ignored; the first one of a section only
    sets the state.  A section without a snapshot for the period ``forget``, by the
    time of the newest snapshot of all hosts, is forgotten: its next one is a first one again.
    Snapshots older than that are late and ignored.  Needs ``session.rocksdb_state`` where it starts.
    """
    return (
        salted_sections(snapshots.withWatermark("taken", forget), salts)
        .groupBy("host", "section", "salt")
        .transformWithStateInPandas(SectionChanges(), CHANGE, "append", "EventTime")
    )


def _last_seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.groupby(["host", "name", "start_time"], as_index=False, dropna=False)["ts"].max()


class Restarts(StatefulProcessor):
    """State of one process: its greatest start time, and when it was last seen.

    A process has few rows at a time, for which a pandas frame of its own takes longer than the rows do.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "start double, ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        host, name = key
        before = self.last.get()
        known, ms = before if before is not None else (0.0, None)
        old = (known, ms)
        rises, starts, seen = [], set(), None
        for row in rows:
            starts.add(row.start_time)
            if row.ms is not None:
                seen = row.ms if seen is None else max(seen, row.ms)
        for start in sorted(starts):
            if known > 0 and start - known > RESTART_GAP_MS:
                rises.append(Row(host=host, name=name, start_before=known, start_now=start))
            known = max(known, start)
        if seen is not None and (ms is None or seen > ms):
            if ms is not None:
                self.handle.deleteTimer(ms)
            self.handle.registerTimer(seen)
            ms = seen
        # Every call to the state is a message of its own: none is sent for what stays.
        if (known, ms) != old:
            self.last.update((known, ms))
        return iter(rises)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def restart_feed(processes: DataFrame, forget: str = FORGET) -> DataFrame:
    """Restarts as process samples (host, name, start_time, ts) arrive.

    Emits when the start time of a process rises by more than a minute.  Equal start times are
    merged where they are read, so what reaches the state is one row per start and not one
    per sample.  A process without a sample for the period ``forget`` is forgotten: its next start is a
    first one.  Samples older than that are late and ignored.  Needs ``session.rocksdb_state``
    where it starts.
    """
    starts = processes.where(F.col("start_time") > 0).select(
        "host", "name", "start_time", F.col("ts").cast("timestamp").alias("ts")
    )
    return (
        starts.mapInPandas(_last_seen, "host string, name string, start_time double, ts timestamp")
        .withWatermark("ts", forget)
        .select("host", "name", "start_time", "ts", F.unix_millis("ts").alias("ms"))
        .groupBy("host", "name")
        .transformWithState(Restarts(), RESTART, "append", "EventTime")
    )
