"""Diagnosis rules as data: built in, or loaded from a JSON file."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdiff.functions.judge import SEVERITIES
from opsdiff.functions.text import valid_metric
from opsdiff.session import broadcast_if_small, small_table
from opsdiff.sources import fixed_values as fixed
from opsdiff.sources.catalog import raise_first, read_json_document

RULES_JSON = (
    "ARRAY<STRUCT<id: STRING, severity: STRING, conclusion: STRING, next: ARRAY<STRING>, "
    "`when`: ARRAY<STRUCT<metric: STRING, verdict: STRING, delta_gte: DOUBLE, delta_lte: DOUBLE, "
    "b_gte: DOUBLE, b_gt_zero: BOOLEAN, appeared: BOOLEAN>>>>"
)
CONDITION_TESTS = ["verdict", "delta_gte", "delta_lte", "b_gte", "b_gt_zero", "appeared"]

_CONDITIONS = pa.schema([
    ("rule_idx", pa.int32()), ("cond_idx", pa.int32()), ("n_conds", pa.int32()),
    ("metric", pa.string()), ("verdict", pa.string()), ("delta_gte", pa.float64()),
    ("delta_lte", pa.float64()), ("b_gte", pa.float64()), ("b_gt_zero", pa.bool_()),
    ("appeared", pa.bool_()),
])
_HEADS = pa.schema([
    ("rule_idx", pa.int32()), ("id", pa.string()), ("severity", pa.string()),
    ("conclusion", pa.string()), ("next", pa.list_(pa.string())),
])


@dataclass(frozen=True)
class Rules:
    """``conditions``: one row per rule and condition; ``heads``: one row per rule."""

    conditions: DataFrame
    heads: DataFrame


def builtin_rules(spark: SparkSession) -> Rules:
    heads, conditions = [], []
    for i, rule in enumerate(fixed.DIAGNOSIS_RULES):
        heads.append({"rule_idx": i, **{k: rule[k] for k in _HEADS.names[1:]}})
        for j, cond in enumerate(rule["when"]):
            conditions.append(
                {"rule_idx": i, "cond_idx": j, "n_conds": len(rule["when"]), **cond}
            )
    return Rules(
        conditions=small_table(spark, conditions, _CONDITIONS),
        heads=small_table(spark, heads, _HEADS),
    )


def load_rules(spark: SparkSession, path: str) -> Rules:
    """Reads and checks a rules file; raises ValueError on the first broken rule."""
    doc = read_json_document(spark, path, RULES_JSON)
    rules = doc.select(F.posexplode("doc").alias("rule_idx", "r")).select("rule_idx", "r.*")
    conditions = rules.select(
        "rule_idx", "id", F.size("when").alias("n_conds"),
        F.posexplode("when").alias("cond_idx", "c"),
    ).select("rule_idx", "id", "cond_idx", "n_conds", "c.*")

    rule_id = F.coalesce(F.col("id"), F.lit(""))
    empty_text = (rule_id == "") | (F.coalesce(F.col("conclusion"), F.lit("")) == "")
    verdict = F.coalesce(F.col("verdict"), F.lit(""))
    problems = (
        doc.where(F.size("doc") <= 0).select(F.lit("the file has no rules").alias("problem"))
        .unionByName(
            rules.where(empty_text | (F.coalesce(F.size("when"), F.lit(0)) <= 0)).select(
                F.concat(F.lit("id, conclusion and conditions are needed: "), rule_id).alias("problem")
            )
        )
        .unionByName(
            rules.groupBy("id").count().where("count > 1").select(
                F.concat(F.lit("id used twice: "), "id").alias("problem")
            )
        )
        .unionByName(
            rules.where(~F.coalesce(F.col("severity").isin(SEVERITIES), F.lit(False))).select(
                F.concat(rule_id, F.lit(" has an unknown severity")).alias("problem")
            )
        )
        .unionByName(
            conditions.where(~valid_metric(F.col("metric"))).select(
                F.concat(rule_id, F.lit(" has a bad metric name")).alias("problem")
            )
        )
        .unionByName(
            conditions.where(~verdict.isin("", "worse", "better", "watch", "flat")).select(
                F.concat(rule_id, F.lit(" has an unknown verdict")).alias("problem")
            )
        )
    )
    raise_first(problems, "rules")
    return Rules(
        conditions=broadcast_if_small(conditions.select(*_CONDITIONS.names)),
        heads=broadcast_if_small(rules.select(*_HEADS.names)),
    )


def export_rules(rules: Rules, path: str) -> None:
    """Writes the rules as one JSON array (one line of text) that load_rules reads back."""
    conditions = rules.conditions.groupBy("rule_idx").agg(
        F.sort_array(
            F.collect_list(F.struct("cond_idx", F.struct("metric", *CONDITION_TESTS).alias("c")))
        ).alias("conds")
    )
    listed = rules.heads.join(conditions, "rule_idx").select(
        "rule_idx",
        F.struct(
            "id", "severity", "conclusion", "next",
            F.transform("conds", lambda p: p["c"]).alias("when"),
        ).alias("r"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("rule_idx", "r")))
    listed.agg(
        F.to_json(F.transform(in_order, lambda p: p["r"])).alias("value")
    ).coalesce(1).write.mode("overwrite").text(path)
