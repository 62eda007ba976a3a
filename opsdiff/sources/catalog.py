"""Metric catalog and trend presets: built in, or loaded from a JSON file."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdiff.functions.text import METRIC_NAME, valid_metric
from opsdiff.session import broadcast_if_small, small_table
from opsdiff.sources import fixed_values as fixed

CATALOG_JSON = (
    "categories ARRAY<STRING>, "
    "metrics ARRAY<STRUCT<metric: STRING, label: STRING, category: STRING, polarity: STRING, "
    "fold: BOOLEAN, threshold_pct: DOUBLE, min_abs: DOUBLE>>, "
    "presets MAP<STRING, STRUCT<label: STRING, metrics: ARRAY<STRING>>>"
)

_METRICS = pa.schema([
    ("metric", pa.string()), ("label", pa.string()), ("category", pa.string()),
    ("polarity", pa.string()), ("fold", pa.bool_()), ("threshold_pct", pa.float64()),
    ("min_abs", pa.float64()), ("cat_idx", pa.int32()), ("metric_idx", pa.int32()),
])
_PRESETS = pa.schema([
    ("preset", pa.string()), ("label", pa.string()), ("pos", pa.int32()), ("metric", pa.string()),
])

# Longest list of names that is pushed into the scan as an IN filter.
MAX_IN_LIST = 1000


def builtin_rows() -> list[dict]:
    """The built-in catalog as dictionaries, defaults filled in."""
    rows, category, cat_idx = [], "", -1
    for line in fixed.METRIC_TABLE.strip().splitlines():
        if line.startswith("["):
            category, cat_idx = line.strip("[]"), cat_idx + 1
            continue
        metric, polarity, threshold, floor, *flags = line.split()
        rows.append({
            "metric": metric,
            "label": metric.split(".", 1)[1].replace(".", " ").replace("_", " "),
            "category": category,
            "polarity": polarity,
            "fold": "fold" in flags,
            "threshold_pct": 0.0 if threshold == "-" else float(threshold),
            "min_abs": 0.0 if floor == "-" else float(floor),
            "cat_idx": cat_idx,
            "metric_idx": len(rows),
            "core": "core" in flags,
        })
    return rows


def core_metrics() -> list[str]:
    """Metrics that may turn a resource block red."""
    return [r["metric"] for r in builtin_rows() if r["core"]]


def is_core(metric: Column) -> Column:
    return metric.isin(core_metrics())


def with_core(rows: DataFrame) -> DataFrame:
    """Adds the flag ``core``."""
    return rows.withColumn("core", is_core(F.col("metric")))


def resource_of(category: Column) -> Column:
    """Resource block of a category, ``other`` when it belongs to none."""
    expr = F.lit("other")
    for name, block in fixed.RESOURCE_OF_CATEGORY.items():
        expr = F.when(category == name, block).otherwise(expr)
    return expr


@dataclass(frozen=True)
class Catalog:
    """``metrics``: one row per metric; ``presets``: one row per preset and metric;
    ``categories``: JSON-ordered names; ``names``: metric names when the list is
    short enough to be pushed into scans, else None (the join still filters)."""

    metrics: DataFrame
    presets: DataFrame
    categories: DataFrame
    names: list[str] | None

    def preset(self, name: str) -> DataFrame:
        return self.presets.where(F.col("preset") == name)


def builtin_catalog(spark: SparkSession, slim: bool = False) -> Catalog:
    """The built-in catalog, or its slim profile without high-cardinality metrics."""
    rows = builtin_rows()
    if slim:
        rows = [r for r in rows if not r["metric"].startswith(tuple(fixed.SLIM_LEAVES_OUT))]
        rows = [{**r, "metric_idx": n} for n, r in enumerate(rows)]
    presets = [
        {"preset": key, "label": label, "pos": pos, "metric": metric}
        for key, label, metrics in fixed.TREND_PRESETS
        for pos, metric in enumerate(metrics)
    ]
    categories = list(dict.fromkeys(r["category"] for r in rows))
    return Catalog(
        metrics=small_table(spark, [{k: r[k] for k in _METRICS.names} for r in rows], _METRICS),
        presets=small_table(spark, presets, _PRESETS),
        categories=small_table(
            spark,
            [{"category": c, "cat_idx": i} for i, c in enumerate(categories)],
            pa.schema([("category", pa.string()), ("cat_idx", pa.int32())]),
        ),
        names=[r["metric"] for r in rows],
    )


def short_list(names: DataFrame) -> list[str] | None:
    """Metric names of a configuration table, or None when there are too many for a filter."""
    found = [r["metric"] for r in names.select("metric").limit(MAX_IN_LIST + 1).collect()]
    return found if len(found) <= MAX_IN_LIST else None


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def with_defaults(metrics: DataFrame) -> DataFrame:
    """Fills thresholds and floors that are 0 or absent from the built-in table;
    a metric that folds there folds here too."""
    known = builtin_rows()
    thresholds = {r["metric"]: r["threshold_pct"] for r in known if r["threshold_pct"] > 0}
    floors = {r["metric"]: r["min_abs"] for r in known if r["min_abs"] > 0}
    folds = [r["metric"] for r in known if r["fold"]]
    metric, none = F.col("metric"), F.lit(0.0)

    def or_default(column: str, defaults: dict) -> Column:
        return F.coalesce(F.nullif(F.col(column), none), _lookup(defaults, metric), none)

    return metrics.withColumns({
        "fold": F.coalesce(F.col("fold"), F.lit(False)) | metric.isin(folds),
        "threshold_pct": or_default("threshold_pct", thresholds),
        "min_abs": or_default("min_abs", floors),
    })


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One configuration file as one column ``doc``; malformed JSON raises."""
    return spark.read.text(path, wholetext=True).select(
        F.from_json("value", schema, {"mode": "FAILFAST"}).alias("doc")
    )


def raise_first(problems: DataFrame, what: str) -> None:
    """Raises ValueError with one of the problems found, if there is any."""
    found = problems.limit(1).collect()
    if found:
        raise ValueError(f"{what}: {found[0]['problem']}")


def _catalog_problems(
    doc: DataFrame, categories: DataFrame, metrics: DataFrame, presets: DataFrame
) -> DataFrame:
    metric = F.coalesce(F.col("metric"), F.lit(""))

    def problem(df: DataFrame, broken: Column, *text: Column) -> DataFrame:
        return df.where(F.coalesce(broken, F.lit(True))).select(F.concat(*text).alias("problem"))

    known = F.coalesce(F.col("cat_idx").isNotNull(), F.lit(False))
    checks = [
        problem(
            doc,
            (F.size("doc.categories") <= 0) | (F.size("doc.metrics") <= 0),
            F.lit("needs categories and metrics"),
        ),
        problem(categories, F.col("category") == "", F.lit("a category has no name")),
        problem(metrics, ~valid_metric(metric), F.lit("bad metric name "), metric),
        problem(metrics, ~known, metric, F.lit(" names a category that is not declared")),
        problem(
            metrics,
            ~F.col("polarity").isin("worse_up", "better_up", "neutral"),
            metric, F.lit(" has an unknown polarity"),
        ),
        problem(
            metrics,
            ~F.coalesce(F.col("threshold_pct"), F.lit(0.0)).between(0, 10000),
            metric, F.lit(" has a threshold outside 0..10000"),
        ),
        problem(
            metrics,
            F.coalesce(F.col("min_abs"), F.lit(0.0)) < 0,
            metric, F.lit(" has a negative floor"),
        ),
        problem(
            presets, F.col("metric").isNull() | ~metric.rlike(METRIC_NAME),
            F.lit("preset "), F.col("preset"), F.lit(" is empty or has a bad metric name"),
        ),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """Reads and checks a catalog file; presets stay built in unless the file has some.

    Raises ValueError on the first broken rule.
    """
    doc = read_json_document(spark, path, CATALOG_JSON)
    # On a repeated category or metric name the last position counts.
    categories = (
        doc.select(F.posexplode("doc.categories").alias("cat_idx", "category"))
        .groupBy("category")
        .agg(F.max("cat_idx").alias("cat_idx"))
    )
    listed = doc.select(F.posexplode("doc.metrics").alias("metric_idx", "m")).select(
        "metric_idx", "m.*"
    )
    metrics = listed.join(categories, "category", "left")
    presets = doc.select(F.explode_outer("doc.presets").alias("preset", "p")).where(
        F.col("preset").isNotNull()
    ).select("preset", F.col("p.label").alias("label"), F.posexplode_outer("p.metrics").alias("pos", "metric"))

    raise_first(_catalog_problems(doc, categories, metrics, presets), "catalog")

    unique = metrics.groupBy("metric").agg(
        F.max_by(F.struct(*[c for c in metrics.columns if c != "metric"]), "metric_idx").alias("m")
    ).select("metric", "m.*")
    full = with_defaults(unique).select(*_METRICS.names)
    has_presets = bool(doc.where(F.col("doc.presets").isNotNull()).count())
    return Catalog(
        metrics=broadcast_if_small(full),
        presets=presets.select(*_PRESETS.names) if has_presets else builtin_catalog(spark).presets,
        categories=categories.select("category", "cat_idx"),
        names=short_list(full),
    )


def export_catalog(catalog: Catalog, path: str) -> None:
    """Writes the effective catalog as one JSON document that load_catalog reads back.

    A catalog is configuration, a document by nature: it is gathered into one row.
    """
    fields = ["metric", "label", "category", "polarity", "fold", "threshold_pct", "min_abs"]

    def in_order(column: Column, by: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.struct(by, column.alias("item"))))
        return F.transform(pairs, lambda p: p["item"])

    metrics = catalog.metrics.agg(in_order(F.struct(*fields), "metric_idx").alias("metrics"))
    categories = catalog.categories.agg(in_order(F.col("category"), "cat_idx").alias("categories"))
    presets = (
        catalog.presets.groupBy("preset")
        .agg(F.first("label").alias("label"), in_order(F.col("metric"), "pos").alias("metrics"))
        .agg(F.map_from_entries(
            F.collect_list(F.struct("preset", F.struct("label", "metrics")))
        ).alias("presets"))
    )
    key = F.lit(1).alias("k")
    doc = (
        categories.select(key, "*")
        .join(metrics.select(key, "*"), "k")
        .join(presets.select(key, "*"), "k")
        .select("categories", "metrics", "presets")
    )
    doc.coalesce(1).write.mode("overwrite").json(path)
