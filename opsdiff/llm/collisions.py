"""Embedding near-dedup: collision-counting projections.

Vectors of a label are projected on many random orthonormal directions.  Two vectors collide in a
direction if one lies in the window centred on the other in that direction's sorted order; pairs
with enough collisions are verified by their cosine.  How many are enough is calibrated: of
random differences as long as the similarity allows, RECALL have at least that count.

The work is dealt in blocks.  Equal vectors of a label are one row with a weight.  Rows are put in
Hilbert order of their first projections and cut into blocks; each block has the range of every
projection.  Directions are orthonormal, so the gaps between two blocks' ranges bound the
distance of any of their pairs: pairs of blocks further apart hold no link.  For every other
pair of blocks of a label one task's row sorts, counts and verifies.  It emits sums per
vector and the edges of a spanning forest, never the pairs, so that a group of near copies, however
large, costs time but no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdiff.llm.common import components, stored
from opsdiff.llm.vectors import block_rows, dimensions, finite, hilbert, in_order, packed, stretches

SIMILARITY = 0.93
PROJECTIONS = 32
RECALL = 0.997
WINDOW = 1.0       # half a window, in typical differences of a pair that is just similar
ORDERED, BITS = 8, 7  # projections in the Hilbert order, bits of each
PACK = 512         # blocks whose ranges travel in one row


def directions(dims: int) -> np.ndarray:
    """dims x PROJECTIONS: columns of random rotations, each rotation's orthonormal."""
    made = [np.linalg.qr(np.random.default_rng(7 + i).standard_normal((dims, dims)))[0] for i in range(-(-PROJECTIONS // dims))]
    return np.hstack(made)[:, :PROJECTIONS]


def distance(similarity: float) -> float:
    """Of two unit vectors with this cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * similarity)))


def half_window(dims: int, similarity: float) -> float:
    return WINDOW * distance(similarity) / np.sqrt(dims) + 1e-9


def enough(dims: int, similarity: float, recall: float = RECALL, trials: int = 40_000) -> int:
    """The count that this share of random differences of the greatest length reach."""
    random = np.random.default_rng(11).standard_normal((trials, dims))
    random *= distance(similarity) / np.linalg.norm(random, axis=1, keepdims=True)
    counts = (np.abs(random @ directions(dims)) <= half_window(dims, similarity)).sum(axis=1)
    return int(np.quantile(counts, 1 - recall, method="lower"))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; none may be zero.  Scaled first, so that no square leaves the range."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def colliding(a: np.ndarray, b: np.ndarray, half: float, least: int) -> np.ndarray:
    """Whether each row of a and of b (projections) collide in at least so many directions."""
    counts = np.zeros((len(a), len(b)), np.uint8)
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j])
        line = b[order, j]
        low = np.searchsorted(line, a[:, j] - half, "left").tolist()
        high = np.searchsorted(line, a[:, j] + half, "right").tolist()
        for query, (start, end) in enumerate(zip(low, high, strict=True)):
            if start < end:
                counts[query, order[start:end]] += 1
    return counts >= least


def linked(a: np.ndarray, b: np.ndarray, maybe: np.ndarray, similarity: float) -> np.ndarray:
    """The pairs of maybe whose cosine (a and b are unit vectors) is enough, a few rows at a time."""
    out = np.zeros_like(maybe)
    for start in range(0, len(a), 256):
        some = maybe[start:start + 256]
        i, j = np.nonzero(some)
        if len(i) > some.size // 20:
            out[start:start + 256] = some & (a[start:start + 256] @ b.T >= similarity)
        elif len(i):
            good = np.einsum("ij,ij->i", a[start + i], b[j]) >= similarity
            out[start + i[good], j[good]] = True
    return out


def forest(i: np.ndarray, j: np.ndarray, nodes: int) -> np.ndarray:
    """For each node the smallest one that the edges (i, j) connect it with."""
    least = np.arange(nodes)
    while True:
        before = least.copy()
        near = np.minimum(least[i], least[j])
        np.minimum.at(least, i, near)
        np.minimum.at(least, j, near)
        least = least[least]
        if (least == before).all():
            return least


def classes(rows: DataFrame, dims: int) -> DataFrame:
    """class, label (string), embedding, first (smallest vec_id), weight of the distinct vectors that can have links."""
    usable = (
        F.col("label").isNotNull() & (F.size("embedding") == dims)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    same = rows.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    return stored(same.withColumn("class", F.monotonically_increasing_id()), "collision-classes")


def blocks_of(distinct: DataFrame, dims: int) -> DataFrame:
    """block, label, members (classes), weights, vectors, low and high of every projection; written."""
    rays = directions(dims)
    ordered, size = min(ORDERED, dims), block_rows(dims)
    reach = 3 / np.sqrt(dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, vectors = finite(batch.column(3), dims)  # all of them: others are no classes
            line = unit(vectors) @ rays[:, :ordered]
            cells = np.clip((line + reach) / (2 * reach) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, BITS))], names=[*batch.schema.names, "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = TaskContext.get().partitionId() << 32
        for number, (label, rows) in enumerate(stretches(batches, size)):
            vectors = np.vstack([finite(c, dims)[1] for c in rows["embedding"].chunks])
            line = unit(vectors) @ rays
            yield pa.record_batch({
                "block": pa.array([start + number]), "label": pa.array([label], pa.string()),
                "members": pa.array([rows["class"].to_pylist()], pa.list_(pa.int64())),
                "weights": pa.array([rows["weight"].to_pylist()], pa.list_(pa.int64())),
                "vectors": pa.array([vectors.tobytes()], pa.binary()),
                "low": pa.array([line.min(axis=0).tolist()]), "high": pa.array([line.max(axis=0).tolist()]),
            })

    keyed = distinct.select(F.col("label").cast("string").alias("label"), "class", "weight", F.col("embedding").cast("array<double>").alias("embedding"))
    placed = keyed.mapInArrow(place, "label string, class long, weight long, embedding array<double>, place long")
    # The class parts what has one label and one place, so that no range holds a hot one whole.
    sorted_ = in_order(placed, distinct.count(), dims, "label", "place", "class")
    kinds = "block long, label string, members array<long>, weights array<long>, vectors binary, low array<double>, high array<double>"
    return stored(sorted_.mapInArrow(cut, kinds), "collision-blocks")


def near_blocks(blocks: DataFrame, dims: int, similarity: float) -> DataFrame:
    """(a, b), a <= b: blocks of one label whose ranges leave room for a link."""
    most = distance(similarity) ** 2 + 1e-9
    first = min(dims, PROJECTIONS)  # one rotation: the squares of gaps add up to no more than the distance's

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low, high, low2, high2 = (np.array(row[c])[:, :first] for c in ("low", "high", "low2", "high2"))
                blocks, blocks2 = np.array(row["block"]), np.array(row["block2"])
                for k, block in enumerate(blocks):
                    gap = np.maximum(0, np.maximum(low[k] - high2, low2 - high[k]))
                    near = (gap * gap).sum(axis=1) <= most
                    if row["pack"] == row["pack2"]:
                        near &= block <= blocks2
                    there = blocks2[near]
                    if len(there):
                        yield pa.record_batch({"a": pa.array(np.minimum(block, there)), "b": pa.array(np.maximum(block, there))})

    packs = stored(packed(blocks, F.col("block"), PACK, ("label",), **{c: F.col(c) for c in ("block", "low", "high")}), "collision-packs")
    twin = packs.select("label", *[F.col(c).alias(f"{c}2") for c in ("pack", "block", "low", "high")])
    return packs.join(twin, "label").where("pack <= pack2").mapInArrow(meet, "a long, b long")


def links(blocks: DataFrame, dims: int, similarity: float) -> DataFrame:
    """class, links (weights of the classes linked), other (a class that it is connected with) of each pair of blocks."""
    rays, half, least = directions(dims), half_window(dims, similarity), enough(dims, similarity)

    def of(row: dict, end: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors = unit(np.frombuffer(row["vectors" + end]).reshape(-1, dims))
        return vectors, np.array(row["members" + end], np.int64), np.array(row["weights" + end], np.int64)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                (one, own, weight), (two, other, weight2) = of(row, ""), of(row, "2")
                found = linked(one, two, colliding(one @ rays, two @ rays, half, least), similarity)
                if row["a"] == row["b"]:  # each pair is there twice, and each vector with itself
                    np.fill_diagonal(found, False)
                    found |= found.T
                    sums, nodes = [(own, found @ weight)], own
                    i, j = np.nonzero(found)
                else:
                    sums = [(own, found @ weight2), (other, found.T @ weight)]
                    nodes = np.concatenate([own, other])
                    i, j = np.nonzero(found)
                    j = j + len(own)
                number = np.concatenate([n for _, n in sums])
                some = np.flatnonzero(number)
                if len(some):
                    least_node = forest(i, j, len(nodes))
                    yield pa.record_batch({"class": pa.array(nodes[some]), "links": pa.array(number[some]), "other": pa.array(nodes[least_node[some]])})

    near = near_blocks(blocks, dims, similarity)
    body = ["members", "weights", "vectors"]
    pairs = near.join(blocks.select(F.col("block").alias("a"), *body), "a").join(
        blocks.select(F.col("block").alias("b"), *[F.col(c).alias(f"{c}2") for c in body]), "b"
    )
    return stored(pairs.mapInArrow(verify, "class long, links long, other long"), "collision-links")


def near_duplicates(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows(vec_id, embedding, label).

    A row without label or vector, with a zero vector, null or not finite entries, or another
    length than most has no links and is its own component.  Rows with equal label and vector
    are linked with each other, repeated rows too.  A component's id is the smallest vec_id in
    it; rows without vec_id take part in links, and in a component without any other have
    component_id null and kept false.  An empty table gives an empty result.
    """
    rows = rows.select("vec_id", "embedding", "label")
    dims = dimensions(rows)
    if not dims:
        alone = F.col("vec_id").cast("long")
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone.alias("component_id"), alone.isNotNull().alias("kept"))
    distinct = classes(rows, dims)
    found = links(blocks_of(distinct, dims), dims, similarity)
    number = found.groupBy("class").agg(F.sum("links").alias("links"))
    node = components(found.where("class != other").select(F.col("class").alias("a"), F.col("other").alias("b")))
    placed = stored(
        distinct.join(number, "class", "left").join(node.select(F.col("node").alias("class"), "component"), "class", "left")
        .where("weight > 1 or links is not null")
        .select("label", "embedding", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
                F.coalesce("component", "class").alias("component")),
        "collision-placed",
    )
    # Written, so that a component that holds many rows is one that the join may split.
    least = stored(placed.groupBy("component").agg(F.min("first").alias("least")), "collision-least")
    known = placed.join(least, "component").select("label", "embedding", "links", "least")
    own = F.col("vec_id").cast("long")
    return rows.join(known, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("links").isNull(), own).otherwise(F.col("least").cast("long")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
