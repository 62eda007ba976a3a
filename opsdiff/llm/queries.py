"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdiff.llm import (
    collisions,
    decontaminate,
    fingerprints,
    hard_negatives,
    html_text,
    lattice,
    line_dedup,
    mixing,
    ngram_join,
    passages,
    secrets,
    toxicity,
    whitening,
)
from opsdiff.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = ~toxicity.held_out(F.col("doc_id"))  # the same quarter of the documents stays unseen
    found = secrets.scan(table(spark, sf_dir, "documents"), train=train)
    return found.select(
        "doc_id", "place", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.length("value").alias("length"),
        "label", "probability", "secret",
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summarise(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.to_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.col("near_edited").cast("double").alias("near_edited"), F.col("near_next").cast("double").alias("near_next"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = documents.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lattice.held_out(F.col("doc_id"))
    rows = lattice.score(table(spark, sf_dir, "documents"), ~held, lattice.read_pieces())
    return rows.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.shifted_labels(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_secret_scan": op3_secret_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_whitening": op11_whitening,
    "op12_near_dedup": op12_near_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"

# Random ranks, 64-bit hashes and trained models have no SQL here; tests hold these against brute force.
ORACLES: dict[str, str] = {
    "op12_near_dedup": f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND {_FINITE} AND len([x for x in embedding if x <> 0]) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {collisions.SIMILARITY}),
reach AS (SELECT vec_id, vec_id AS node FROM embeddings UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON p.a = r.node),
least AS (SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id),
number AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN number ON number.a = e.vec_id""",
    "op13_hard_negatives": f"""WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor({hard_negatives.SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS y
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, CAST(list_dot_product(a.y, v.y) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hard_negatives.POSITIVES})
SELECT anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM p JOIN (SELECT * FROM s WHERE NOT same) n USING (anchor_id)
WHERE {hard_negatives.LOWEST} * p.score <= 100 * n.score AND 100 * n.score <= {hard_negatives.HIGHEST} * p.score
WINDOW w AS (PARTITION BY anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= {hard_negatives.NEGATIVES}""",
}
