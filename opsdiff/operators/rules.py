"""Diagnosis: rows matched against rules, findings, and the software block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdiff.functions.judge import SEVERITIES, condition_holds, rank_in
from opsdiff.functions.text import evidence_line
from opsdiff.operators.diff import order_key
from opsdiff.sources.rules import CONDITION_TESTS, Rules


def rule_hits(rows: DataFrame, rules: Rules) -> DataFrame:
    """Every (row, condition) pair that matches."""
    tests = F.struct(*CONDITION_TESTS).alias("c")
    conditions = rules.conditions.select("rule_idx", "cond_idx", "n_conds", "metric", tests)
    joined = rows.join(conditions, "metric")
    holds = condition_holds(lambda f: F.col(f"c.{f}"), F.col)
    return joined.where(holds).drop("c")


def first_hits(rows: DataFrame, rules: Rules) -> DataFrame:
    """The first matching row, in report order, of every condition."""
    shown = F.struct("metric", "instance", "a", "b", "delta_pct")
    return (
        rule_hits(rows, rules)
        .groupBy("host", "rule_idx", "cond_idx", "n_conds")
        .agg(F.min_by(shown, order_key()).alias("hit"))
    )


def findings(rows: DataFrame, rules: Rules) -> DataFrame:
    """Rules of which every condition has a hit, with one piece of evidence per condition.

    What is collected per group is one entry per condition of one rule.
    """
    line = evidence_line(
        F.col("hit.metric"), F.col("hit.instance"), F.col("hit.a"), F.col("hit.b"),
        F.col("hit.delta_pct"),
    )
    per_rule = (
        first_hits(rows, rules)
        .groupBy("host", "rule_idx", "n_conds")
        .agg(F.sort_array(F.collect_list(F.struct("cond_idx", line.alias("line")))).alias("e"))
        .where(F.size("e") == F.col("n_conds"))
    )
    return per_rule.join(rules.heads, "rule_idx").select(
        "host", "rule_idx", "id", "severity", "conclusion",
        F.transform("e", lambda x: x["line"]).alias("evidence"), "next",
        rank_in(F.col("severity"), SEVERITIES).alias("severity_rank"),
    )


def by_severity(found: DataFrame) -> DataFrame:
    """Sorted for output: critical first, rule order within a severity."""
    return found.orderBy("host", "severity_rank", "rule_idx")


def software_block(found: DataFrame, hosts: DataFrame) -> DataFrame:
    """Fifth block of the board: number of findings, red if one is critical."""
    counted = found.groupBy("host").agg(
        F.count("*").alias("n"), F.max(F.col("severity") == "crit").alias("crit")
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    return hosts.select("host").join(counted, "host", "left").select(
        "host", F.lit(4).alias("pos"), F.lit("software").alias("key"),
        F.lit("Software").alias("label"),
        F.when(F.coalesce("crit", F.lit(False)), "bad")
        .when(n > 0, "warn").otherwise("ok").alias("status"),
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" finding(s)")))
        .otherwise("nothing found").alias("headline"),
        F.lit(None).cast("double").alias("worst_pct"),
    )
