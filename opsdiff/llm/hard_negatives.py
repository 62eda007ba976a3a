"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Components become whole numbers, so that every score is exact.  Candidates are written as Parquet in
blocks, ordered by label and place on a Hilbert curve through the dimensions that vary most.
Each block's row has the smallest and greatest entry per dimension, its zone map.  Interval
arithmetic on a zone map bounds the scores of a whole block with an anchor from above and below;
an anchor's window of wanted scores reads the blocks whose bounds meet it.

Two searches follow one another.  For positives the window opens at the last of the best scores
in the anchor's own block, which is known when the blocks are cut.  For negatives it is given
by the positive's score; the most promising blocks are read first, and the scores found there
raise the window's lower end before the other blocks are chosen.  Bounds never leave a row out
that belongs to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsdiff.llm.common import stored
from opsdiff.llm.vectors import block_rows, dimensions, finite, hilbert, in_order, packed, stretches

SCALE = 256
LARGEST = 1 << 24        # an entry from here on cannot be scored in a long with room to spare
POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90  # percent of the positive's score
ORDERED, BITS = 10, 6    # dimensions in the Hilbert order, bits of each
GROUP = 256              # anchors that travel together
PACK = 512               # zone maps that travel together
FIRST = 2                # blocks read before the others are chosen
ANY_LOW, ANY_HIGH = -(1 << 62), 1 << 62

BLOCK = "kind string, block long, label string, ids array<long>, vectors binary, low array<long>, high array<long>, floor long"
ASK = "struct<ask:int,low:long,high:long,positive_id:long,positive_score:long>"
FOUND = "ref long, anchor_id long, ask int, positive_id long, positive_score long, found_id long, score long"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two whole-number matrices, exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most): anchors x blocks, between which all scores with a block's rows lie."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def best(score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first scores, falling, ties by smaller id."""
    if len(score) > 4 * keep:
        floor = np.partition(score, len(score) - keep)[len(score) - keep]
        some = np.flatnonzero(score >= floor)
        return some[np.lexsort((ids[some], -score[some]))[:keep]]
    return np.lexsort((ids, -score))[:keep]


def whole_numbers(rows: DataFrame, dims: int) -> DataFrame:
    """label (string), place, vec_id, vector of the rows that take part."""
    entries = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    good = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") == dims)
        & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float(LARGEST // SCALE), F.lit(False)))
    )
    vectors = rows.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), entries.cast("array<int>").alias("vector"), F.col("label").cast("string").alias("label"))
    return vectors


def spread(vectors: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, deviations) per dimension."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * dims)
        for batch in batches:
            _, x = finite(batch.column(0), dims)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.record_batch({"part": pa.array([total.tolist()])})

    parts = vectors.select("vector").mapInArrow(task, "part array<double>").select(F.posexplode("part").alias("at", "x"))
    got = np.array(parts.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toArrow()["x"].to_pylist() or [0.0] * (1 + 2 * dims))
    n = max(got[0], 1.0)
    mean = got[1:dims + 1] / n
    return int(got[0]), mean, np.sqrt(np.maximum(got[dims + 1:] / n - mean * mean, 0))


def cut(rows: DataFrame, dims: int, every: int) -> DataFrame:
    """The blocks, and as rows of kind 'anchor' the anchors, with the score their own block promises; written."""
    vectors = whole_numbers(rows, dims)
    count, mean, deviation = spread(vectors, dims)
    chosen = np.argsort(-deviation, kind="stable")[:ORDERED]
    middle, reach = mean[chosen], 3 * np.maximum(deviation[chosen], 1e-9)
    size = block_rows(dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = finite(batch.column(1), dims)
            cells = np.clip((x[:, chosen] - middle + reach) / (2 * reach) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(hilbert(cells, BITS)), batch.column(0), batch.column(1)], names=["label", "place", "vec_id", "vector"]
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated rows are neighbours; one of them stays."""
        last = None
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            _, x = finite(batch.column(3), dims)
            labels = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (x[1:] != x[:-1]).any(axis=1)
            if last is not None and last[0] == batch.column(0)[0].as_py() and last[1] == ids[0] and (last[2] == x[0]).all():
                new[0] = False
            last = batch.column(0)[-1].as_py(), ids[-1], x[-1].copy()
            yield batch if new.all() else batch.filter(pa.array(new))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        seen = 0
        for label, table in stretches(once(batches), size):
            x = np.vstack([finite(c, dims)[1] for c in table["vector"].chunks]).astype(np.int64)
            ids = table["vec_id"].combine_chunks().to_numpy()
            made = [("block", number, label, ids.tolist(), x.astype(np.int32).tobytes(), x.min(axis=0).tolist(), x.max(axis=0).tolist(), 0)]
            own = np.flatnonzero(ids % every == 0)
            for start in range(0, len(own), GROUP):
                some = own[start:start + GROUP]
                for at, score in zip(some, products(x[some], x), strict=True):
                    score = np.delete(score, at)
                    floor = int(np.partition(score, len(score) - POSITIVES)[len(score) - POSITIVES]) if len(score) >= POSITIVES else ANY_LOW
                    # An anchor's number: its group, and its place in the group.
                    group = (TaskContext.get().partitionId() << 32) + seen // GROUP
                    made.append(("anchor", group, label, [int(ids[at]), seen % GROUP], x[at].astype(np.int32).tobytes(), None, None, floor))
                    seen += 1
            number += 1
            yield pa.RecordBatch.from_pydict(
                dict(zip(["kind", "block", "label", "ids", "vectors", "low", "high", "floor"], map(list, zip(*made, strict=True)), strict=True)),
                pa.schema([("kind", pa.string()), ("block", pa.int64()), ("label", pa.string()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()),
                           ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("floor", pa.int64())]),
            )

    placed = vectors.mapInArrow(place, "label string, place long, vec_id long, vector array<int>")
    ranged = in_order(placed, count, dims, "label", "place", "vec_id").sortWithinPartitions("label", "place", "vec_id", "vector")
    return stored(ranged.mapInArrow(blocks, BLOCK), "negative-blocks")


def matrix(packed_rows: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed_rows), np.int32).reshape(-1, dims).astype(np.int64)


def grouped(anchors: DataFrame) -> DataFrame:
    """group, all (its anchors, GROUP at most) of rows group, ref, anchor_id, label, vector, asks."""
    return anchors.groupBy("group").agg(F.collect_list(F.struct("ref", "anchor_id", "label", "vector", "asks")).alias("all"))


def chosen_blocks(groups: DataFrame, zones: DataFrame, dims: int, same: bool) -> DataFrame:
    """(group, block, reach): the blocks that some window of a group's anchors must read, and the greatest score it may find."""
    packs = packed(zones, F.col("block"), PACK, **{c: F.col(c) for c in ("block", "label", "low", "high")})
    count = packs.select(F.max("pack")).first()[0]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                anchors = [a for a in row["all"] if a["asks"]]
                if not anchors:
                    continue
                least, most = bounds(matrix([a["vector"] for a in anchors], dims), np.array(row["low"], np.int64), np.array(row["high"], np.int64))
                names = {name: i for i, name in enumerate(dict.fromkeys([a["label"] for a in anchors] + row["label"]))}
                equal = np.array([names[a["label"]] for a in anchors])[:, None] == np.array([names[x] for x in row["label"]])
                of = np.array([i for i, a in enumerate(anchors) for _ in a["asks"]])
                low = np.array([q["low"] for a in anchors for q in a["asks"]])[:, None]
                high = np.array([q["high"] for a in anchors for q in a["asks"]])[:, None]
                need = (equal[of] == same) & (most[of] >= low) & (least[of] <= high)
                reach = np.where(need, np.minimum(most[of], high), ANY_LOW).max(axis=0)
                some = np.flatnonzero(need.any(axis=0))
                if len(some):
                    yield pa.record_batch({
                        "group": pa.array(np.full(len(some), row["group"])), "block": pa.array(np.array(row["block"])[some]), "reach": pa.array(reach[some]),
                    })

    # Every group meets every pack of zone maps: a fixed set of queries against all blocks.
    asked = groups.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count or 0).cast("long"))).alias("pack"), "group", "all")
    return asked.join(packs, "pack").drop("pack").mapInArrow(choose, "group long, block long, reach long")


def search(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, dims: int, same: bool, keep: int) -> DataFrame:
    """The first keep rows of each pair's block in each ask's window."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                anchors = [a for a in row["all"] if a["asks"] and (a["label"] == row["label"]) == same]
                if not anchors:
                    continue
                x, ids = matrix([row["vectors"]], dims), np.array(row["ids"], np.int64)
                of = matrix([a["vector"] for a in anchors], dims)
                least, most = bounds(of, np.array([row["low"]], np.int64), np.array([row["high"]], np.int64))
                need = np.array([
                    any(most[i, 0] >= q["low"] and least[i, 0] <= q["high"] for q in a["asks"]) for i, a in enumerate(anchors)
                ])
                found: list[tuple] = []
                some = np.flatnonzero(need)
                for i, score in zip(some, products(of[some], x), strict=True):
                    anchor = anchors[i]
                    other = np.ones(len(ids), bool)
                    if same:
                        other = (ids != anchor["anchor_id"]) | (x != of[i]).any(axis=1)
                    for q in anchor["asks"]:
                        there = np.flatnonzero(other & (score >= q["low"]) & (score <= q["high"]))
                        for at in there[best(score[there], ids[there], keep)]:
                            found.append((anchor["ref"], anchor["anchor_id"], q["ask"], q["positive_id"], q["positive_score"], int(ids[at]), int(score[at])))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int32() if n == "ask" else pa.int64()) for n, c in zip(names, zip(*found, strict=True), strict=True)], names=names
                    )

    body = blocks.select("block", "label", "ids", "vectors", "low", "high")
    return pairs.select("group", "block").join(body, "block").join(groups, "group").mapInArrow(read, FOUND)


def first_of(found: DataFrame, keep: int) -> DataFrame:
    """The first rows of each ask, with rank."""
    order = W.partitionBy("ref", "ask").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def floor_div(x: Column, by: int) -> Column:
    """The quotient rounded down, of longs."""
    return ((x - F.pmod(x, F.lit(by).cast("long"))) / by).cast("long")


def mine(rows: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows(vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by every.  Rows without vec_id, label or vector, with null,
    not finite or very large entries (65,536 and more), or with another length than most take no part.  Rows that
    repeat vec_id, label and vector are one; other rows of one vec_id are rows of their own.
    Ties go by smaller id.  An anchor without positives, and a positive whose window is empty, give no
    rows; an empty table gives an empty result.  Other columns are not looked at.
    """
    rows = rows.select("vec_id", "embedding", "label")
    dims = dimensions(rows)
    if not dims:
        none = [F.lit(None).cast(t).alias(c) for c, t in [("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long")]]
        return rows.select(F.col("vec_id").cast("long").alias("anchor_id"), *none).where("false")
    all_ = cut(rows, dims, every)
    blocks = all_.where("kind = 'block'")
    zones = blocks.select("block", "label", "low", "high")
    every_score = F.array(F.struct(
        F.lit(0).alias("ask"), F.col("floor").alias("low"), F.lit(ANY_HIGH).alias("high"), F.lit(None).cast("long").alias("positive_id"), F.lit(None).cast("long").alias("positive_score"),
    ))
    anchors = all_.where("kind = 'anchor'").select(
        F.col("block").alias("group"), (F.col("block") * GROUP + F.col("ids")[1]).alias("ref"), F.col("ids")[0].alias("anchor_id"), "label", F.col("vectors").alias("vector"), every_score.alias("asks"),
    )

    groups = stored(grouped(anchors), "negative-groups")
    pairs = chosen_blocks(groups, zones, dims, same=True)
    positives = stored(first_of(search(pairs, groups, blocks, dims, True, POSITIVES), POSITIVES), "negative-positives")

    score = F.col("score")
    window = positives.select(
        "ref", F.struct(
            F.col("rank").alias("ask"), (-floor_div(-score * LOWEST, 100)).alias("low"), floor_div(score * HIGHEST, 100).alias("high"),
            F.col("found_id").alias("positive_id"), score.alias("positive_score"),
        ).cast(ASK).alias("q"),
    ).where("q.low <= q.high")
    asks = window.groupBy("ref").agg(F.collect_list("q").alias("asks"))  # POSITIVES at most
    asking = anchors.drop("asks").join(asks, "ref")
    groups = stored(grouped(asking), "negative-groups")
    pairs = stored(chosen_blocks(groups, zones, dims, same=False), "negative-pairs")
    promising = W.partitionBy("group").orderBy(F.desc("reach"), "block")
    first = stored(pairs.withColumn("nth", F.row_number().over(promising)).where(F.col("nth") <= FIRST), "negative-first")
    found = stored(first_of(search(first, groups, blocks, dims, False, NEGATIVES), NEGATIVES), "negative-found")

    # Where a window is full already, only scores as good as its last can still come in.
    full = found.groupBy("ref", "ask").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == NEGATIVES)
    opened = asking.select("group", "ref", "anchor_id", "label", "vector", F.explode("asks").alias("q")).withColumn("ask", F.col("q.ask"))
    raised = opened.join(full, ["ref", "ask"], "left").withColumn("q", F.col("q").withField("low", F.coalesce("least", "q.low")))
    again = raised.groupBy("group", "ref").agg(F.first("anchor_id").alias("anchor_id"), F.first("label").alias("label"), F.first("vector").alias("vector"), F.collect_list("q").alias("asks"))
    groups = stored(grouped(again), "negative-groups")
    rest = chosen_blocks(groups, zones, dims, same=False).join(first.select("group", "block"), ["group", "block"], "left_anti")
    more = search(rest, groups, blocks, dims, False, NEGATIVES)
    result = first_of(found.drop("rank").unionByName(more), NEGATIVES)
    return result.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted_labels(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, embedding, label: the next label where vec_id is divisible by every."""
    wide = F.col("label").cast("decimal(20,0)")
    moved = F.when(F.col("vec_id") % every == 0, (wide + 1) % labels).otherwise(wide)
    return rows.select("vec_id", "embedding", moved.cast("long").alias("label"))
