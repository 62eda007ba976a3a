"""State snapshots as facts: as-of selection, differences and counts.

Facts are one row per (host, taken, section, key); ``headers`` are the distinct
(host, taken) pairs of the snapshots.  Presence is a flag of its own: a fact
with an empty value is there, an absent one is not.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsdiff.operators.chunks import DAY, latest_at_or_before, sortable, with_previous
from opsdiff.operators.windows import time_literal
from opsdiff.session import broadcast_if_small
from opsdiff.sources.fixed_values import SECURITY_SYSCTL, STATE_SECTIONS, VOLATILE_SYSCTL

CHANGE_KINDS = ["added", "removed", "modified"]


def is_volatile(key: Column) -> Column:
    """Kernel parameters that are no configuration or belong to the security section."""
    exact = SECURITY_SYSCTL + VOLATILE_SYSCTL
    match = key.isin(exact)
    for prefix in [k for k in VOLATILE_SYSCTL if k.endswith(".")]:
        match = match | key.startswith(prefix)
    return match


def section_title(section: Column) -> Column:
    """Title of a known section, else the name itself."""
    expr = section
    for name, title, _ in STATE_SECTIONS:
        expr = F.when(section == name, title).otherwise(expr)
    return expr


def section_rank(section: Column) -> Column:
    """Report position of a section; unknown ones come last."""
    expr = F.lit(len(STATE_SECTIONS))
    for i, (name, _, _) in enumerate(STATE_SECTIONS):
        expr = F.when(section == name, F.lit(i)).otherwise(expr)
    return expr


def change_kind(has_a: Column, has_b: Column, old: Column, new: Column) -> Column:
    """added, removed, modified, or NULL when nothing changed; notes are not compared."""
    return (
        F.when(has_a & has_b, F.when(~old.eqNullSafe(new), "modified"))
        .when(has_b, "added")
        .when(has_a, "removed")
    )


# ---- snapshot selection ----------------------------------------------------


def headers_of(facts: DataFrame) -> DataFrame:
    return facts.select("host", "taken").distinct()


def latest(headers: DataFrame) -> DataFrame:
    """Newest snapshot of every host."""
    return headers.groupBy("host").agg(F.max("taken").alias("taken"))


def snapshot_asof(headers: DataFrame, t: datetime, strict: bool = True) -> DataFrame:
    """Newest snapshot of every host taken at or before ``t``.

    Without ``strict`` a host that has only later ones gives its earliest.
    """
    taken = F.col("taken")
    before = F.max(F.when(taken <= time_literal(headers, "taken", t), taken))
    chosen = before if strict else F.coalesce(before, F.min("taken"))
    return headers.groupBy("host").agg(chosen.alias("taken")).where(taken.isNotNull())


def snapshot_asof_join(anchors: DataFrame, headers: DataFrame, strict: bool = True) -> DataFrame:
    """snapshot_asof for many moments: ``anchors(host, t, ...)`` gains ``taken``."""
    found = latest_at_or_before(anchors, headers, "host", "t", "taken", "taken")
    if strict:
        return found.where(F.col("taken").isNotNull())
    first = headers.groupBy("host").agg(F.min("taken").alias("_first"))
    return (
        found.join(first, "host")
        .withColumn("taken", F.coalesce("taken", "_first"))
        .drop("_first")
    )


def newest(headers: DataFrame, n: int) -> DataFrame:
    """The n newest snapshots of all hosts, newest first."""
    return headers.select("host", "taken").orderBy(F.desc("taken"), "host").limit(n)


def retained(table: DataFrame, now: datetime, keep_days: int = 7) -> DataFrame:
    """Rows not older than the retention period."""
    cutoff = now - timedelta(days=keep_days)
    kept = table.where(F.col("taken") >= time_literal(table, "taken", cutoff))
    return kept.where(F.col("date") >= F.lit(cutoff.date())) if "date" in table.columns else kept


# ---- differences -----------------------------------------------------------


def _diff(sided: DataFrame, group: list[str]) -> DataFrame:
    """Changes between the two sides of every group.

    ``sided`` has (group, section, key, value, note, seq, side) and, unless
    sections have their built-in titles, title.  Both sides meet in one grouping
    on (group, section, key): no join, and of a key delivered twice the last
    (greatest seq) stands.
    """
    side = F.col("side")
    titled = "title" in sided.columns
    last = F.struct("seq", "value", "note", *(["title"] if titled else []))
    keyed = sided.groupBy(*sortable([*group, "section", "key"])).agg(
        F.max(F.when(side == "a", last)).alias("old"),
        F.max(F.when(side == "b", last)).alias("new"),
    )
    has_a, has_b = F.col("old").isNotNull(), F.col("new").isNotNull()
    changed = keyed.withColumn(
        "kind", change_kind(has_a, has_b, F.col("old.value"), F.col("new.value"))
    ).where(F.col("kind").isNotNull())
    if titled:
        # A section is titled by B, else by A, whichever of its facts changed.  Titles come from the
        # grouped facts, whose shuffle both branches share.
        def greatest(side: str) -> Column:
            return F.max(F.nullif(F.col(side)["title"], F.lit("")))

        titles = keyed.groupBy(*sortable([*group, "section"])).agg(
            F.coalesce(greatest("new"), greatest("old"), F.lit("")).alias("title")
        ).drop("_order")
        changed = changed.join(titles, [*group, "section"])
    else:
        changed = changed.withColumn("title", section_title(F.col("section")))
    return changed.select(
        *group, "section", "title", "key", "kind",
        F.col("old.value").alias("old"), F.col("new.value").alias("new"),
        F.when(has_b, F.col("new.note")).otherwise(F.col("old.note")).alias("note"),
        section_rank(F.col("section")).alias("section_rank"),
    )


def _side(facts: DataFrame, side: Column, group: list[str], titled: bool) -> DataFrame:
    have = facts.columns
    note = F.coalesce("note", F.lit("")) if "note" in have else F.lit("")
    title = [F.col("title") if "title" in have else section_title(F.col("section")).alias("title")]
    return facts.select(
        *group, "section", *(title if titled else []), "key", "value", note.alias("note"),
        (F.col("seq") if "seq" in have else F.lit(0)).alias("seq"), side.alias("side"),
    )


def state_diff(
    facts_a: DataFrame, facts_b: DataFrame, skipped: DataFrame | None = None
) -> DataFrame:
    """Changes of every host between one snapshot per side.

    A section that one side had to skip shows all its facts as added or
    removed; pass ``skipped(host, section)`` to leave such sections out.
    """
    titled = "title" in facts_a.columns or "title" in facts_b.columns
    both = _side(facts_a, F.lit("a"), ["host"], titled).unionByName(
        _side(facts_b, F.lit("b"), ["host"], titled)
    )
    changes = _diff(both, ["host"])
    if skipped is None:
        return changes
    return changes.join(skipped.select("host", "section"), ["host", "section"], "left_anti")


def diff_pairs(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """state_diff for many pairs of snapshots: ``pairs(host, a_taken, b_taken)``.

    Facts meet their pairs by equality on (host, taken), so the table of facts
    is read once; a fact that serves as A of one pair and B of another counts
    in both.
    """
    ends = pairs.select(
        "host", "a_taken", "b_taken",
        F.inline(F.array(
            F.struct(F.col("a_taken").alias("taken"), F.lit("a").alias("side")),
            F.struct(F.col("b_taken").alias("taken"), F.lit("b").alias("side")),
        )),
    )
    on = ["host", "taken"]
    if "date" in facts.columns:
        ends = ends.withColumn("date", F.to_date("taken"))
        on.append("date")
    # Pairs of one report, two rows per host, spare the facts a shuffle by (host, taken).
    ends = broadcast_if_small(ends)
    group = ["host", "a_taken", "b_taken"]
    titled = "title" in facts.columns
    return _diff(_side(facts.join(ends, on), F.col("side"), group, titled), group)


def consecutive_pairs(headers: DataFrame) -> DataFrame:
    """Every snapshot with the one before it on the same host."""
    return (
        with_previous(headers, ["host"], "taken", "taken", "a_taken", 30 * DAY)
        .where(F.col("a_taken").isNotNull())
        .select("host", "a_taken", F.col("taken").alias("b_taken"))
    )


def snapshot_neighbours(headers: DataFrame) -> DataFrame:
    """Every snapshot with the times of the one before and after it on its host, NULL at the ends."""
    stepped = with_previous(headers.select("host", "taken"), ["host"], "taken", "taken", "before", 30 * DAY)
    none = F.lit(None).cast(headers.schema["taken"].dataType)
    before = F.col("before")
    ends = stepped.select("host", F.inline(F.array_compact(F.array(
        F.struct("taken", "before", none.alias("after")),
        F.when(before.isNotNull(), F.struct(before.alias("taken"), none.alias("before"), F.col("taken").alias("after"))),
    ))))
    return ends.groupBy("host", "taken").agg(F.max("before").alias("before"), F.max("after").alias("after"))


FACT_OF = ["host", "section", "key"]


def _bordered(facts: DataFrame, headers: DataFrame) -> DataFrame:
    """Facts beside the same fact in the snapshots before and after.

    Adds before and after (times of the neighbour snapshots), old (what the fact was in the one before) and
    held (whether it is in the one after, and with the same value).  The facts are shuffled once, by
    fact: repeats, the order in time and what follows all need no more than that.
    """
    around = broadcast_if_small(snapshot_neighbours(headers).withColumnRenamed("taken", "_taken"))
    near = facts.join(around.withColumnRenamed("host", "_host"), (F.col("host") == F.col("_host")) & (F.col("taken") == F.col("_taken")))
    have = facts.columns
    note = F.coalesce("note", F.lit("")) if "note" in have else F.lit("")
    seq = F.col("seq") if "seq" in have else F.lit(0)
    one = near.select(
        *FACT_OF, "taken", "before", "after", F.struct(seq.alias("seq"), "value", note.alias("note")).alias("f")
    ).repartition(*FACT_OF)
    # Of a key delivered twice in a snapshot the last stands.
    in_time = Window.partitionBy(*FACT_OF).orderBy("taken", "f")
    last = one.withColumn("_next", F.lead("taken").over(in_time)).where(
        F.col("_next").isNull() | (F.col("_next") != F.col("taken"))
    )
    in_time = Window.partitionBy(*FACT_OF).orderBy("taken")
    there = F.struct("taken", F.col("f.value").alias("value"), F.col("f.note").alias("note"))
    beside = last.withColumns({"_old": F.lag(there).over(in_time), "_new": F.lead(there).over(in_time)})
    value = F.col("f.value")
    return beside.select(
        *FACT_OF, "taken", "before", "after", value.alias("value"), F.col("f.note").alias("note"),
        F.when(F.col("_old.taken") == F.col("before"), F.col("_old")).alias("old"),
        F.when(F.col("_new.taken") == F.col("after"), value.eqNullSafe(F.col("_new.value"))).alias("held"),
    )


def fact_intervals(facts: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Validity of every value: (host, section, key, value, note, since, until, ended).

    A row for each stretch of neighbouring snapshots that hold the value; since and until are the
    first and last of them, note is that of the first.  ``ended`` is the time of the snapshot that
    has another value or none, NULL while the value stands.
    """
    headers = headers_of(facts) if headers is None else headers
    here = _bordered(facts, headers)
    starts = F.col("old").isNull() | ~F.col("old.value").eqNullSafe(F.col("value"))
    ends = ~F.coalesce(F.col("held"), F.lit(False))
    edges = here.withColumns({"_starts": starts, "_ends": ends}).where(F.col("_starts") | F.col("_ends"))
    in_time = Window.partitionBy(*FACT_OF).orderBy("taken")
    close = F.struct(F.col("taken").alias("until"), F.col("after").alias("ended"))
    closed = edges.withColumn("_close", F.when(F.col("_ends"), close).otherwise(F.lead(close).over(in_time)))
    return closed.where("_starts").select(
        *FACT_OF, "value", "note", F.col("taken").alias("since"), "_close.until", "_close.ended"
    )


def _titles(facts: DataFrame, sections: DataFrame | None) -> DataFrame:
    """(host, taken, section, title) of sections that have one."""
    of = facts if sections is None else sections
    named = of.where(F.col("title") != "")
    return named.groupBy("host", "taken", "section").agg(F.max("title").alias("title"))


def consecutive_diff(
    facts: DataFrame, headers: DataFrame | None = None, sections: DataFrame | None = None
) -> DataFrame:
    """Changes between each snapshot and the one before, over the whole history.

    A fact appears where the snapshot before lacks it, and goes where the next snapshot
    does: a gap between its snapshots that the headers do not have.  ``headers`` and ``sections``
    are those stored with the snapshots; without them they are made from the facts.
    """
    headers = headers_of(facts) if headers is None else headers
    here = _bordered(facts, headers)
    old = F.col("old")
    event = F.when(old.isNull(), "added").when(~old["value"].eqNullSafe(F.col("value")), "modified")
    none = F.lit(None).cast("string")
    arrived = F.when(F.col("before").isNotNull() & event.isNotNull(), F.struct(
        F.col("before").alias("a_taken"), F.col("taken").alias("b_taken"), event.alias("kind"),
        old["value"].alias("old"), F.col("value").alias("new"), F.col("note").alias("note"),
    ))
    left = F.when(F.col("after").isNotNull() & F.col("held").isNull(), F.struct(
        F.col("taken").alias("a_taken"), F.col("after").alias("b_taken"), F.lit("removed").alias("kind"),
        F.col("value").alias("old"), none.alias("new"), F.col("note").alias("note"),
    ))
    events = here.select(*FACT_OF, F.inline(F.array_compact(F.array(arrived, left))))
    if "title" in facts.columns or sections is not None:
        titles = _titles(facts, sections)
        for side in ("b", "a"):
            events = events.join(
                titles.select("host", F.col("taken").alias(f"{side}_taken"), "section", F.col("title").alias(f"_{side}")),
                ["host", f"{side}_taken", "section"], "left",
            )
        title = F.coalesce("_b", "_a", F.lit(""))
    else:
        title = section_title(F.col("section"))
    return events.select(
        "host", "a_taken", "b_taken", "section", title.alias("title"), "key", "kind", "old", "new", "note",
        section_rank(F.col("section")).alias("section_rank"),
    )


def choose_pair(
    headers: DataFrame, a: datetime | None = None, b: datetime | None = None,
    since: timedelta = DAY,
) -> DataFrame:
    """The snapshots to compare, per host: (host, a_taken, b_taken).

    B is the latest one, or the latest at or before ``b``.  A is the latest at
    or before ``a``; without ``a``, the latest at or before B minus ``since``,
    else the earliest.  A snapshot is never compared with itself: a host that
    has just one gives no pair.
    """
    taken = F.col("taken")
    until_b = taken if b is None else F.when(taken <= time_literal(headers, "taken", b), taken)
    if a is not None:
        until_a = F.when(taken <= time_literal(headers, "taken", a), taken)
        pairs = headers.groupBy("host").agg(F.max(until_a).alias("a_taken"), F.max(until_b).alias("b_taken"))
    else:
        # One row per snapshot beside the chosen B of its host: the headers are read once.
        back = F.make_dt_interval(secs=F.lit(since.total_seconds()))
        chosen = headers.select("host", "taken", F.max(until_b).over(Window.partitionBy("host")).alias("b_taken"))
        near = F.max(F.when(taken <= F.col("b_taken") - back, taken))
        pairs = (
            chosen.where(taken < F.col("b_taken"))
            .groupBy("host", "b_taken")
            .agg(F.coalesce(near, F.min("taken")).alias("a_taken"))
        )
    return pairs.where(F.col("a_taken") != F.col("b_taken")).select("host", "a_taken", "b_taken")


# ---- counts ----------------------------------------------------------------


def _kind_counts() -> list[Column]:
    return [F.count("*").alias("total")] + [
        F.count_if(F.col("kind") == k).alias(k) for k in CHANGE_KINDS
    ]


def change_counts(changes: DataFrame, by_section: bool = True) -> DataFrame:
    """Changes per kind, by host and section or by host."""
    keys = ["host", "section", "title"] if by_section else ["host"]
    return changes.groupBy(*keys).agg(*_kind_counts())


def changed(changes: DataFrame, hosts: DataFrame) -> DataFrame:
    """Alert flag per host: anything changed."""
    some = changes.select("host").distinct().withColumn("some", F.lit(True))
    return hosts.select("host").join(some, "host", "left").select(
        "host", F.coalesce("some", F.lit(False)).alias("changed")
    )


def snapshot_stats(facts: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Facts per host, snapshot and section, with the reason when it was skipped."""
    counted = facts.select(
        "host", "taken", "section", F.lit(1).alias("n"), F.lit(None).cast("string").alias("skipped")
    )
    if sections is not None:
        counted = counted.unionByName(
            sections.select("host", "taken", "section", F.lit(0).alias("n"),
                            F.nullif("skipped", F.lit("")).alias("skipped"))
        )
    return counted.groupBy("host", "taken", "section").agg(
        F.sum("n").alias("facts"), F.max("skipped").alias("skipped")
    )


def snapshot_totals(stats: DataFrame) -> DataFrame:
    """Facts, sections and skipped sections per snapshot."""
    return stats.groupBy("host", "taken").agg(
        F.sum("facts").alias("facts"), F.count("*").alias("sections"),
        F.count("skipped").alias("skipped"),
    )


def in_change_order(changes: DataFrame) -> DataFrame:
    """Sorted for output: sections in report order, then keys."""
    return changes.orderBy("host", "section_rank", "section", "key")
