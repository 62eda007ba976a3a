"""First-wins and last-wins duplicates, distinct unions and coverage.

All are aggregates with a map-side step, so a key with very many copies is
reduced where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdiff.operators.chunks import sortable
from opsdiff.session import broadcast_if_small
from opsdiff.sources.catalog import Catalog


def _one_per_key(df: DataFrame, keys: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*sortable(keys)).agg(pick(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")


def dedupe_first(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The first row of every key."""
    return _one_per_key(df, keys, lambda row: F.min_by(row, order))


def dedupe_last(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The last row of every key."""
    return _one_per_key(df, keys, lambda row: F.max_by(row, order))


def union_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of both sides."""
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def union_warnings(*parts: DataFrame) -> DataFrame:
    """Warnings of several runs, each text once, with the order it was first seen in.

    Parts have (host, seq, warning); later parts come after earlier ones.
    """
    tagged = [p.select("host", F.lit(i).alias("part"), "seq", "warning") for i, p in enumerate(parts)]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    return out.groupBy("host", "warning").agg(F.min(F.struct("part", "seq")).alias("seen"))


def coverage(warnings: DataFrame) -> DataFrame:
    """Metrics that warnings name as not recorded (``... for <metric>: ...``), per host.

    A warning of another form stands for itself.
    """
    named = F.regexp_extract("warning", r"for ([\w.]+):", 1)
    name = F.when(named != "", named).otherwise(F.col("warning"))
    return warnings.select("host", name.alias("metric")).distinct()


WORD = 64  # metrics whose presence travels in one number


def seen_metrics(samples: DataFrame, numbered: DataFrame) -> DataFrame:
    """(host, words): of every host the numbers (metric, word, bit) of the metrics it has, as bits by word.

    The samples are aggregated once, with a map-side step over numbers: one row per host and 64
    metrics.  A host that has none of the metrics is there with an empty map.
    """
    known = samples.select("host", "metric").join(broadcast_if_small(numbered), "metric", "left")
    bits = known.groupBy("host", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    word = F.when(F.col("word").isNotNull(), F.struct("word", "bits"))
    return bits.groupBy("host").agg(F.map_from_entries(F.collect_list(word)).alias("words"))


def missing_metrics(
    samples: DataFrame, wanted: DataFrame, hosts: DataFrame | None = None
) -> DataFrame:
    """Wanted metrics of which a host has no sample: (host, metric).

    ``samples`` is already cut to the window.  The wanted metrics are numbered, hosts are a bitmap
    of those numbers, and only what is missing becomes rows.
    """
    names = wanted.agg(F.array_sort(F.collect_set("metric")).alias("all"))
    place = F.col("place")
    numbered = names.select(F.posexplode("all").alias("place", "metric")).select(
        "metric", F.floor(place / WORD).cast("int").alias("word"), (place % WORD).alias("bit")
    )
    seen = seen_metrics(samples, numbered)
    if hosts is not None:
        seen = hosts.select("host").join(seen, "host", "left")
    every = numbered.agg(F.collect_list(F.struct("metric", "word", "bit")))
    absent = F.filter(
        "every", lambda m: ~F.coalesce(F.getbit(F.try_element_at("words", m["word"]), m["bit"]) == 1, F.lit(False))
    )
    return seen.withColumn("every", every.scalar()).select("host", F.explode(F.transform(absent, lambda m: m["metric"])).alias("metric"))


def missing_catalog_metrics(
    samples: DataFrame, catalog: Catalog, hosts: DataFrame | None = None
) -> DataFrame:
    """Catalog metrics that a host did not record."""
    return missing_metrics(samples, catalog.metrics, hosts)
