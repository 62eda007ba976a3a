"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words.  A document's expected number of copies is its
source's target over the source's size; the whole part is allocated as certain copies.
For the rest the documents of a source are ranked by random odds over inclusion odds,
u/(1-u) : p/(1-p), and taken from the smallest rank on until the words wanted are reached
(Rosen's Pareto order sampling, its fixed size being a number of words).  With a column
of merits the inclusion probabilities differ between the documents of a source.

No source is sorted in one task: ranks are cut into bins, the words of the bins are
summed before the shuffle, and only the bin that holds the threshold is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsdiff.llm.common import WORD, sized_broadcast, stored

BROADCAST_SOURCES = 100_000
ROWS_PER_BIN = 4_096


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target (double) to (source, source_size, weight).

    The words to hand out are share * all sizes, divided by weight; a target stops at
    most * its source's size, and the excess goes to the other sources by weight until
    none is above.  Each round is one aggregate; only two numbers come to the driver.
    """
    limit = F.col("source_size") * F.lit(most)
    total = (sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0) * share
    level, full = None, -1  # words for a weight of 1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= limit
        row = sources.agg(
            F.sum(F.when(over, limit)).alias("fixed"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
            F.count_if(over).alias("full"),
        ).first()
        if row["full"] == full or not row["weight"]:
            break
        level, full = (total - (row["fixed"] or 0.0)) / row["weight"], row["full"]
    reached = F.lit(level or 0.0) * F.col("weight")
    return sources.withColumn("target", F.least(reached, limit).cast("double"))


def uniform(seed: int, *columns: str) -> Column:
    """A number strictly between 0 and 1 for each row, the same in every run."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def mix(documents: DataFrame, sources: DataFrame, seed: int = 17, merit: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Adds source_size, target and copies (long) to documents(doc_id, source, size).

    sources has (source, source_size, target).  sizes: the same rows without wide columns,
    for the counts; the documents are then read once.  A null source is a source of its own.
    Repeated rows are documents of their own and share a rank, ties are cut in the order
    of size, doc_id and text_key if there is one.  An empty document (size 0) is never taken.
    merit: a positive column; expected copies of a document are in proportion to it.
    Where that would go past ceil(target / source size) the copies stop there.
    """
    n_sources = sources.count()
    narrow = documents if sizes is None else sizes

    def beside(rows: DataFrame, per_source: DataFrame, source: str, how: str = "inner") -> DataFrame:
        per_source = sized_broadcast(per_source, n_sources, BROADCAST_SOURCES)
        return rows.join(per_source, rows["source"].eqNullSafe(per_source[source]), how)

    def ranked(rows: DataFrame) -> DataFrame:
        rows = beside(rows, sources.select(F.col("source").alias("_s"), "source_size", "target"), "_s")
        expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        if merit:
            mean = narrow.groupBy(F.col("source").alias("_m")).agg((F.sum(F.col(merit) * F.col("size")) / F.sum("size")).alias("_mean"))
            rows = beside(rows, mean, "_m").drop("_m")
            expected = F.least(expected * F.col(merit) / F.col("_mean"), F.ceil(expected).cast("double"))
        rows = rows.withColumn("_e", expected).withColumn("_whole", F.when(F.col("size") > 0, F.floor("_e")).otherwise(0)).withColumn("_p", F.col("_e") - F.col("_whole"))
        # Random odds over inclusion odds, brought to (0, 1): q/(1+q) keeps the order.
        u = uniform(seed, "doc_id")
        odds = (u / (1 - u)) * ((1 - F.col("_p")) / F.col("_p"))
        return rows.withColumn("_rank", F.when((F.col("_p") > 0) & (F.col("size") > 0), odds / (1 + odds)))

    counts = ranked(narrow).groupBy("_s").agg(
        F.count("_rank").alias("_n"), F.sum(F.col("_whole") * F.col("size")).alias("_certain"), F.max("target").alias("_t")
    ).select(F.col("_s").alias("_c"), (F.col("_t") - F.col("_certain")).alias("_wanted"),
             F.greatest(F.lit(1), F.ceil(F.col("_n") / ROWS_PER_BIN) * 2).cast("long").alias("_bins"))
    counts = stored(counts, "mix-counts")

    def binned(rows: DataFrame) -> DataFrame:
        return beside(ranked(rows), counts, "_c").withColumn("_bin", F.least(F.floor(F.col("_rank") * F.col("_bins")), F.col("_bins") - 1))

    # The bin in which the words wanted are reached, for each source.
    bins = binned(narrow).where(F.col("_rank").isNotNull()).groupBy("_s", "_bin").agg(
        F.sum("size").alias("_words"), F.max("_wanted").alias("_wanted")
    )
    upto = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("_after", F.sum("_words").over(upto)).withColumn("_before", F.col("_after") - F.col("_words"))
    edge = bins.where((F.col("_before") < F.col("_wanted")) & (F.col("_after") >= F.col("_wanted")))
    edge = stored(edge.select(F.col("_s").alias("_b"), F.col("_bin").alias("_edge"), "_before"), "mix-edges")
    rows = beside(binned(documents), edge, "_b", "left")
    ties = ["size", "doc_id"] + [c for c in ("text_key",) if c in documents.columns]
    inside = rows.where(F.col("_bin") == F.col("_edge"))
    run = Window.partitionBy("_s").orderBy("_rank", *ties)
    running = F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("_upto", F.col("_before") + running)
    # The document that crosses the line is taken if that ends nearer to it.
    extra_inside = (F.col("_upto") - F.col("_wanted") < F.col("_wanted") - (F.col("_upto") - F.col("size"))).cast("long")
    outside = rows.where(~F.coalesce(F.col("_bin") == F.col("_edge"), F.lit(False)))
    extra_outside = F.when(
        F.col("_rank").isNotNull() & (F.col("_wanted") > 0)
        & F.coalesce(F.col("_bin") < F.col("_edge"), F.lit(True)), F.lit(1)
    ).otherwise(0).cast("long")
    keep = [*documents.columns, "source_size", "target"]
    return outside.select(*keep, (F.col("_whole") + extra_outside).cast("long").alias("copies")).unionByName(
        inside.select(*keep, (F.col("_whole") + extra_inside).cast("long").alias("copies"))
    )


def ranked_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Adds weight: sources by code point, null last, get the weights in turn, repeating.

    The place of a source is found over ranges: sources are dealt out by range, each range
    is numbered by itself, and the ranges' counts are added up.  So no task gets them all.
    """
    from_low = F.col("source").asc_nulls_last()
    ranged = stored(
        sources.repartitionByRange(sources.sparkSession.sparkContext.defaultParallelism, from_low)
        .withColumn("_part", F.spark_partition_id()),
        "mix-sources",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    place = F.row_number().over(Window.partitionBy("_part").orderBy(from_low)) - 1 + F.col("_before")
    turn = (place % len(weights)).cast("int")
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1))
        .drop("_part", "_before")
    )


def mixed_sizes(documents: DataFrame, share: float = 1.5, most: float = 2.0,
                weights: tuple[float, ...] = (5.0, 2.0, 1.0), seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """documents(doc_id, text, source) -> doc_id, source, size, source_size, target, copies.

    Null or empty texts have size 0, count for nothing and are never taken; a source
    without words has target 0.  An empty table gives an empty result.
    keep: further columns to carry along; text_key, a hash of the text, breaks ties.
    """
    sizes = stored(
        documents.select("doc_id", "source", text_size(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"), *keep),
        "mix-sizes",
    )
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(stored(ranked_weights(per_source), "mix-weights"), share, most), "mix-targets")
    return mix(sizes, targets, seed)


def mixed_documents(documents: DataFrame, share: float = 1.5, most: float = 2.0,
                    weights: tuple[float, ...] = (5.0, 2.0, 1.0), seed: int = 17) -> DataFrame:
    """The documents the mix takes, all columns, and copies: how often each is taken."""
    wide = documents.select("doc_id", "source", text_size(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"), F.struct("*").alias("row"))
    sizes = stored(wide.drop("row"), "mix-sizes")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(stored(ranked_weights(per_source), "mix-weights"), share, most), "mix-targets")
    taken = mix(wide, targets, seed, sizes=sizes).where("copies > 0")
    return taken.select(*[F.col("row").getField(c).alias(c) for c in documents.columns if c != "copies"], "copies")
