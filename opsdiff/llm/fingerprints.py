"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so that its
size follows the document's, sketches merge by union, and containment can be estimated
between a paragraph and a book.  A text whose shingles all lie above the fraction keeps its
smallest hash, so that only a text without words has an empty sketch.

A fingerprint is the sorted sketch as text: 16 hexadecimal digits for each hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsdiff.llm.common import folded, stored, words

SHINGLE = 5
FRACTION = 1 / 8


def bound(fraction: float) -> int:
    """Hashes are signed; those below this are the fraction kept."""
    return -(1 << 63) + int((1 << 64) * fraction)


def sketch(text: Column, k: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """array<long>: the sorted distinct hashes kept; empty for a null text or one without words.

    A text of fewer than k words is one shingle.
    """
    hashes = F.transform(words(folded(text)), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        whole = F.array(F.xxhash64(h))
        each = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(F.slice(h, i + 1, k)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < k, whole).otherwise(each)

    def kept(all_: Column) -> Column:
        low = F.array_distinct(F.filter(all_, lambda x: x < F.lit(bound(fraction))))
        least = F.when(F.size(all_) > 0, F.array(F.array_min(all_))).otherwise(all_)
        return F.when(F.size(low) > 0, F.sort_array(low)).otherwise(least)

    # A lambda's variable is computed once, where a column would be written out at each use.
    one = F.transform(F.array(hashes), lambda h: F.struct(shingles(h).alias("s")))
    return F.transform(one, lambda x: kept(x["s"]))[0]


def to_text(hashes: Column) -> Column:
    """16 hexadecimal digits a hash, in order of the hashes."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def below(hashes: Column, fraction: float = FRACTION) -> Column:
    return F.filter(hashes, lambda x: x < F.lit(bound(fraction)))


def likeness(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two sketches, 0 to 1.

    Two empty sketches are alike (1), an empty one is like no other (0).  Where neither
    has a hash below the fraction their smallest hashes decide.
    """
    both = F.size(F.array_intersect(a, b))
    low_a, low_b = below(a, fraction), below(b, fraction)
    either = F.size(F.array_union(low_a, low_b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .when(either == 0, (both > 0).cast("double"))
        .otherwise(F.size(F.array_intersect(low_a, low_b)) / either)
    )


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of the first text's shingles that the second has; null if the first has none kept."""
    low = below(a, fraction)
    return F.when(F.size(low) > 0, F.size(F.array_intersect(low, below(b, fraction))) / F.size(low))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts' shingles together."""
    union = F.array_union(a, b)
    low = below(union, fraction)
    return F.when(F.size(low) > 0, F.sort_array(low)).when(F.size(union) > 0, F.array(F.array_min(union))).otherwise(union)


def successors(ids: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, next_id) for distinct ids that are not null: the next greater one, after the last the first.

    Ids are dealt out by range; each range finds its own pairs, and one row a range
    links the last of it to the first of the next range that has any.
    """
    ranged = stored(
        ids.where("doc_id is not null").distinct().repartitionByRange(partitions, "doc_id")
        .withColumn("_part", F.spark_partition_id()),
        "ids",
    )
    ends = ranged.groupBy("_part").agg(F.min("doc_id").alias("_first"))
    in_order = Window.orderBy("_part")  # one row a range
    links = ends.select(
        "_part",
        F.coalesce(F.lead("_first").over(in_order), F.min("_first").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_link"),
    )
    within = F.lead("doc_id").over(Window.partitionBy("_part").orderBy("doc_id"))
    return ranged.withColumn("_next", within).join(F.broadcast(links), "_part").select(
        "doc_id", F.coalesce("_next", "_link").alias("next_id")
    )


def edited_fingerprints(documents: DataFrame, k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Sketches of each text, of its edited form and its likeness to that and to the next document.

    documents(doc_id, text) -> doc_id, n_chars, edited (text), sketch, edited_sketch,
    near_edited, near_next.  The edited text has the last floor(n_chars / 4) code points
    replaced by the first as many, or all, of the next document's.  A null text is empty.
    Where rows repeat a doc_id each has a row of its own; of several next documents with
    one id the part and sketch that sort first are used.  Rows without doc_id have no next
    document: nothing replaces the end of their text, near_next is their likeness to ''.
    """
    every = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Both joins below start from the same rows, so that the texts are shuffled once.
    docs = every.where("doc_id is not null")
    parts = max(8, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = documents.select("doc_id")
    pairs = stored(successors(ids, parts), "next-ids")
    lengths = docs.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4)).alias("wanted"))
    wanted = pairs.join(lengths, "doc_id").select(F.col("doc_id").alias("of_id"), F.col("next_id").alias("doc_id"), "wanted")
    # What each document gives to the one before it: a part of its text and its sketch.
    given = (
        docs.join(wanted, "doc_id")
        .select(F.col("of_id").alias("doc_id"),
                F.struct(F.col("text").substr(F.lit(1), F.col("wanted").cast("int")).alias("tail"),
                         sketch(F.col("text"), k, fraction).alias("next_sketch")).alias("given"))
        .groupBy("doc_id").agg(F.min("given").alias("given")).select("doc_id", "given.*")
    )
    head = F.col("text").substr(F.lit(1), (F.length("text") - F.floor(F.length("text") / 4)).cast("int"))
    tail = F.substring(F.coalesce(F.col("tail"), F.lit("")), F.lit(1), F.floor(F.length("text") / 4).cast("int"))
    linked = docs.join(given, "doc_id", "left").unionByName(every.where("doc_id is null"), allowMissingColumns=True)
    return (
        linked.withColumn("edited", F.concat(head, tail))
        .select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited",
                sketch(F.col("text"), k, fraction).alias("sketch"), sketch(F.col("edited"), k, fraction).alias("edited_sketch"),
                F.coalesce("next_sketch", F.array().cast("array<bigint>")).alias("next_sketch"))
        .withColumns({"near_edited": likeness(F.col("sketch"), F.col("edited_sketch"), fraction),
                      "near_next": likeness(F.col("sketch"), F.col("next_sketch"), fraction)})
        .drop("next_sketch")
    )
