"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z folded.  Every run of five words of a test item is a
seed.  Where a document is read, its runs are held against a bitmap of all seeds, of fixed
size; the few that may be seeds are joined to them.  A seed is rare for an item unless it
is found far more often than the item's seeds are on the whole, so that a common phrase within
an item does not count, and an item that very many documents copy still does.  A document and
an item with a rare seed, or two other seeds, near one diagonal are aligned locally by words:
the score is the alignment's over that of the whole item with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdiff.llm import hashing
from opsdiff.llm.bitmaps import among, bitmap, place
from opsdiff.llm.common import maybe_among, stored

SEED_WORDS = 5
BITS = 24                  # of the seeds' bitmap: 2 MB
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
TIMES_MEDIAN = 8           # a seed found more often than so many times the item's median is common


def _seeds(found: hashing.Words, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row's words, hash) of all runs of the given numbers of words."""
    firsts = np.concatenate([[0], np.cumsum(found.per_row())])
    out = [hashing.runs(found, k, short=False) for k in lengths]
    row, first, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return row, first - firsts[row], h


def item_words(items: DataFrame) -> DataFrame:
    """item_id, words (hashes) of items(item_id, text) that have any."""
    kind = dict(items.dtypes)["item_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in hashing.parts(batches, 1):
            found = hashing.words(part.column(1), hashing.LETTERS, latin=True)
            yield pa.record_batch([part.column(0), hashing.lists(found.row, found.hash, len(part), pa.int64())], names=["item_id", "words"])

    return items.select("item_id", "text").mapInArrow(read, f"item_id {kind}, words array<long>").where("size(words) > 0")


def item_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(item_id, length of the item, seed, at); an item shorter than a seed is one seed."""
    kind = dict(items.dtypes)["item_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in hashing.parts(batches, 1):
            found = hashing.words(part.column(1), hashing.LETTERS, latin=True)
            count = found.per_row()
            for k in lengths:
                row, at, h = _seeds(found, [k])
                own = np.minimum(count, SEED_WORDS)[row] == k
                row, at, h = row[own], at[own], h[own]
                yield pa.record_batch(
                    [part.column(0).take(pa.array(row)), pa.array(count[row].astype(np.int32)), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32))],
                    names=["item_id", "length", "seed", "at"],
                )

    return items.select("item_id", "text").mapInArrow(read, f"item_id {kind}, length int, seed long, at int")


def hits(documents: DataFrame, seeds: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, seed, pos) of runs of words of documents(key, text) that may be seeds."""
    sent = documents.sparkSession.sparkContext.broadcast(bitmap(seeds.select(place(F.col("seed"), BITS).alias("place")), BITS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in hashing.parts(batches, 1):
            row, pos, h = _seeds(hashing.words(part.column(1), hashing.LETTERS, latin=True), lengths)
            there = among(sent.value, h, BITS)
            yield pa.record_batch(
                [part.column(0).take(pa.array(row[there])), pa.array(h[there].view(np.int64)), pa.array(pos[there].astype(np.int32))],
                names=["key", "seed", "pos"],
            )

    return documents.select("key", "text").mapInArrow(read, "key long, seed long, pos int")


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, word after the last) of the best local alignment of an item in words."""
    n = len(words)
    steps = -GAP * np.arange(1, n + 1)
    above = np.zeros(n + 1, np.int64)
    start_above = np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        slant = above[:-1] + np.where(words == word, MATCH, MISMATCH)
        down = above[1:] + GAP
        value = np.maximum(slant, down)
        start = np.where(slant >= down, start_above[:-1], start_above[1:])
        fresh = value <= 0
        value, start = np.where(fresh, 0, value), np.where(fresh, np.arange(1, n + 1), start)
        # Gaps along the words: the best cell to the left, less the way from it.
        lifted = value + steps
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(n), 0))
        along = reach - steps
        start = np.where(along > value, start[source], start)
        value = np.maximum(value, along)
        top = int(value.argmax()) if n else 0
        if n and value[top] > best[0]:
            best = (int(value[top]), int(start[top]), top + 1)
        above, start_above = np.concatenate([[0], value]), np.concatenate([[0], start])
    return best


def leaks(documents: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """key, item_id, score, from_word, to_word: the best alignment of each document and item that reaches the score.

    documents(doc_id, text), items(item_id, text).  key is a hash of doc_id and text, so rows
    that repeat both are one document.  Null and empty texts and items have no words and take no
    part; repeated items are found each.  Without items or documents the result is empty.
    """
    docs = documents.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    # Items are told apart by id and text: several texts of one id are items of their own.
    names = stored(items.select(F.xxhash64("item_id", "text").alias("item"), "item_id").distinct(), "leak-names")
    items = items.select(F.xxhash64("item_id", "text").alias("item_id"), "text").distinct()
    words_of_items = stored(item_words(items), "leak-items")
    lengths = sorted(r["k"] for r in words_of_items.select(F.least(F.size("words"), F.lit(SEED_WORDS)).alias("k")).distinct().collect())  # five at most
    lengths = lengths or [SEED_WORDS]
    seeds = stored(item_seeds(items, lengths), "leak-seeds")
    found = stored(hits(docs, seeds, lengths), "leak-hits")

    often = found.groupBy("seed").agg(F.count("*").alias("times"))
    of_item = stored(seeds.join(often, "seed"), "leak-often")
    usual = of_item.groupBy("item_id").agg(F.percentile_approx("times", 0.5).alias("median"))
    of_item = of_item.join(usual, "item_id").withColumn("rare", F.col("times") <= F.col("median") * TIMES_MEDIAN)
    matches = found.join(of_item.select("seed", "item_id", "length", "at", "rare"), "seed").withColumn("diagonal", F.col("pos") - F.col("at"))
    wide = F.greatest(F.col("length"), F.lit(16))
    windows = matches.groupBy("key", "item_id", F.floor(F.col("diagonal") / wide).alias("near")).agg(
        F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"), F.max("length").alias("length"),
        F.max("rare").alias("rare"), F.count("*").alias("seeds"),
    ).where("rare or seeds > 1")
    spare = (F.col("length") / 2).cast("int") + 2
    windows = windows.select("key", "item_id", F.greatest(F.lit(0), F.col("lo") - spare).alias("lo"), (F.col("hi") + F.col("length") + spare).alias("hi"))
    windows = windows.join(words_of_items.dropDuplicates(["item_id"]), "item_id")
    kind = dict(items.dtypes)["item_id"]
    per_text = stored(windows.groupBy("key").agg(F.collect_list(F.struct("item_id", "lo", "hi", "words")).alias("windows")), "leak-windows")
    asked = maybe_among(docs, "key", per_text).dropDuplicates(["key"]).join(per_text, "key")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in hashing.parts(batches, 1):
            found = hashing.words(part.column(1), hashing.LETTERS, latin=True)
            firsts = np.concatenate([[0], np.cumsum(found.per_row())])
            rows = []
            for r, spans in enumerate(part.column(2).to_pylist()):
                words = found.hash[firsts[r]:firsts[r + 1]]
                for w in spans:
                    item = np.array(w["words"], np.int64).view(np.uint64)
                    value, start, end = align(item, words[w["lo"]:w["hi"]])
                    rows.append((part.column(0)[r].as_py(), w["item_id"], value / (MATCH * len(item)), w["lo"] + start, w["lo"] + end))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            names = ["key", "item_id", "score", "from_word", "to_word"]
            types = [pa.int64(), part.column(2).type.value_type.field("item_id").type, pa.float64(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    scored = asked.mapInArrow(score, f"key long, item_id {kind}, score double, from_word int, to_word int").where(F.col("score") >= least_score)
    named = scored.withColumnRenamed("item_id", "item").join(names, "item")
    best = named.groupBy("key", "item_id").agg(F.max(F.struct("score", -F.col("from_word"), "to_word")).alias("b"))
    return best.select("key", "item_id", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("from_word"), F.col("b.to_word").alias("to_word"))


def contaminated(documents: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, from_word, to_word (places in the document's words, the last exclusive)."""
    found = leaks(documents, items, least_score)
    ids = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("key"))
    return ids.join(found, "key").select("doc_id", "item_id", "score", "from_word", "to_word")


def without_leaks(documents: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents, all columns, of which no test item is a part."""
    bad = stored(leaks(documents, items, least_score).select("key").distinct(), "leak-keys")
    rows = documents.select(F.xxhash64("doc_id", "text").alias("key"), F.struct("*").alias("row"))
    clean = rows.join(bad, "key", "left_anti")
    return clean.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
