"""Verdicts on a pair of values.  Everything here is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW_KINDS = ["worse", "new", "watch", "gone", "better", "flat"]
PROC_KINDS = ["worse", "appeared", "gone", "better", "flat"]
SEVERITIES = ["crit", "warn", "info"]


def pct_change(a: Column, b: Column) -> Column:
    """Change in percent of abs(a); 0 for 0 -> 0, NULL for 0 -> x and for a missing side."""
    return F.when(b == a, F.lit(0.0)).otherwise(F.try_divide(b - a, F.abs(a)) * 100.0)


def verdict_for(up: Column, polarity: Column) -> Column:
    """Direction of the change read through the polarity of the metric."""
    return (
        F.when(polarity == "worse_up", F.when(up, "worse").otherwise("better"))
        .when(polarity == "better_up", F.when(up, "better").otherwise("worse"))
        .otherwise("watch")
    )


def effective_threshold(own: Column, requested: Column) -> Column:
    """A metric's own threshold wins when it is above zero, be it stricter or looser."""
    return F.when(own > 0, own).otherwise(requested)


def judge(a: Column, b: Column, polarity: Column, threshold: Column, min_abs: Column) -> Column:
    """struct(delta_pct, exceeded, verdict) for two window means.

    A missing side is always ``watch``.  When both sides stay below the
    absolute floor, or the change below the threshold, the row is ``flat``.
    The threshold is inclusive, so threshold 0 with a = b != 0 counts as
    exceeded and "not up": an unchanged worse_up metric is then called
    ``better`` and an unchanged better_up one ``worse``.
    """
    missing = a.isNull() | b.isNull()
    floor = F.coalesce(min_abs, F.lit(0.0))
    quiet = (floor > 0) & (F.abs(a) < floor) & (F.abs(b) < floor)
    delta = pct_change(a, b)
    exceeded = (
        F.when(missing, True)
        .when(quiet, False)
        .when(a == 0, b != 0)
        .otherwise(F.abs(delta) >= threshold)
    )
    verdict = (
        F.when(missing, "watch").when(~exceeded, "flat").otherwise(verdict_for(b > a, polarity))
    )
    return F.struct(
        delta.alias("delta_pct"), exceeded.alias("exceeded"), verdict.alias("verdict")
    )


def row_kind(a: Column, b: Column, verdict: Column) -> Column:
    """The verdict, or ``new`` / ``gone`` when only one side has a value."""
    return (
        F.when(a.isNull() & b.isNotNull(), "new")
        .when(b.isNull() & a.isNotNull(), "gone")
        .otherwise(verdict)
    )


def rank_in(value: Column, order: list[str]) -> Column:
    """Position of a value in a fixed order."""
    expr = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        expr = F.when(value == name, F.lit(i)).otherwise(expr)
    return expr


def triage_weight(delta: Column) -> Column:
    """Size of a change on the triage board: an undefined percentage beats any number."""
    return F.coalesce(F.abs(delta), F.lit(1e18))


def display_weight(delta: Column, a: Column, b: Column) -> Column:
    """Size of a change in lists: a missing side is infinite, 0 -> x counts as nothing."""
    return F.coalesce(
        F.abs(delta),
        F.when(a.isNull() | b.isNull(), F.lit(float("inf"))).otherwise(F.lit(0.0)),
    )


def judge_proc(a: Column, b: Column, threshold: Column) -> Column:
    """struct(delta_pct, exceeded, verdict) for a process: more is always worse, no floor."""
    delta = pct_change(a, b)
    verdict = (
        F.when(a.isNull() & b.isNull(), "flat")
        .when(a.isNull(), "appeared")
        .when(b.isNull(), "gone")
        .when(a == 0, F.when(b == 0, "flat").otherwise("worse"))
        .when(F.abs(delta) < threshold, "flat")
        .when(b > a, "worse")
        .otherwise("better")
    )
    return F.struct(
        delta.alias("delta_pct"), (verdict != "flat").alias("exceeded"), verdict.alias("verdict")
    )


RESTART_GAP_MS = 60_000


def restarted(start_a: Column, start_b: Column) -> Column:
    """Known on both sides and started more than a minute later in B."""
    return F.coalesce((start_a > 0) & (start_b - start_a > RESTART_GAP_MS), F.lit(False))


def condition_holds(cond, row) -> Column:
    """All tests that a rule condition sets hold for the row; a NULL value fails a set test.

    ``cond`` and ``row`` map a field name to its Column.
    """

    def test(is_set: Column, holds: Column) -> Column:
        return ~F.coalesce(is_set, F.lit(False)) | F.coalesce(holds, F.lit(False))

    return (
        test(cond("verdict") != "", row("verdict") == cond("verdict"))
        & test(cond("appeared"), row("a").isNull() & row("b").isNotNull())
        & test(cond("b_gt_zero"), row("b") > 0)
        & test(cond("b_gte").isNotNull(), row("b") >= cond("b_gte"))
        & test(cond("delta_gte").isNotNull(), row("delta_pct") >= cond("delta_gte"))
        & test(cond("delta_lte").isNotNull(), row("delta_pct") <= cond("delta_lte"))
    )
