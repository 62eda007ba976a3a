"""What the operators of this folder share: tables, stored steps, words, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdiff.session import delete_path

# Words are runs of anything but ASCII white space; letters A-Z are folded, no others.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; only a local session may lack that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


TEXTS_AT_ONCE = 2_000  # rows of an Arrow batch, for texts of some KB each
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Inside, Python gets batches of so many rows at most; the session's own setting is put back."""
    before = spark.conf.get(ARROW_ROWS)
    if most and not 0 < int(before) <= most:
        spark.conf.set(ARROW_ROWS, str(most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """The table written to the shared folder and read back: its lineage ends there.

    The files stay for as long as the caller keeps the shared folder, since the result
    of an operator is read later than the operator returns.  batch_rows: for steps in Python on
    large rows, of which a batch is held by the JVM and by Python at a time.
    """
    path = shared_path(df.sparkSession, name)
    with arrow_rows(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*steps: DataFrame) -> None:
    """Deletes the folders of stored tables whose last reader is stored itself."""
    for step in steps:
        for folder in {file.rpartition("/")[0] for file in step.inputFiles()}:
            delete_path(step.sparkSession, folder)


def folded(text: Column | str) -> Column:
    """A-Z in lower case, everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text that is not null, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def sized_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Asks for a broadcast if the rows, which the caller has counted, are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; a component is its smallest node.

    Minimum labels travel along the edges and then along the labels themselves, so that
    the rounds grow with the logarithm of a chain's length.  Every grouping has partial
    sums and every join is one that Spark can split, so a node with very many edges does
    not meet in one task.  Each round is written to the shared folder.
    """
    both = stored(
        edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))),
        "edges",
    )
    labels = stored(
        both.groupBy("node").agg(F.min("other").alias("least"))
        .select("node", F.least("node", "least").alias("component")),
        "labels",
    )
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("near")), "other")
            .groupBy("node").agg(F.min("near").alias("near"))
        )
        moved = labels.join(around, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        # The label's own label: halves the way that is left.
        jump = moved.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = stored(
            moved.join(jump, "component", "left").select(
                "node", "was", F.least("component", F.coalesce("further", "component")).alias("component")
            ),
            "labels",
        )
        changed = moved.where(F.col("component") < F.col("was")).limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of components(...) once more links (a, b) are known; written.

    Components take the place of their nodes, so that each pair of them is one edge, however many
    links it has, and the earlier edges are not walked again.
    """
    of_a, of_b = [found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab"]
    whole = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    whole = whole.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    further = components(whole)
    moved = found.join(further.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
    moved = moved.select("node", F.coalesce("further", "component").alias("component"))
    # Nodes that had no link before; a component's name is a node of it.
    return stored(moved.unionByName(further.join(found.select("node"), "node", "left_anti")), "labels")


def slices(batch: pa.RecordBatch, column: int, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in one column take up to so many bytes, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + size, "right")))
        yield batch.slice(start, end - start)
        start = end


MEMBER_BITS = 26  # 8 MB, whatever the number of members


def maybe_among(rows: DataFrame, column: str, members: DataFrame, bits: int = MEMBER_BITS, inside: bool = True) -> DataFrame:
    """The rows whose 64-bit hash may be in the column of the same name of members; inside=False: all others, which are not.

    A join that follows decides; this only keeps most other rows out of its shuffle.  The
    members become a bitmap of fixed size, made in blocks and sent to every executor.
    """
    def split(df: DataFrame) -> tuple[Column, Column]:
        place = F.shiftrightunsigned(df[column], 64 - bits)
        return F.shiftright(place, 15), place.bitwiseAND(F.lit(32767))

    block, within = split(members)
    blocks = members.select(block.alias("_block"), within.alias("_inside")).groupBy("_block").agg(
        F.expr("bitmap_construct_agg(_inside)").alias("_bits")
    )
    # As numbers of 64 bits, the first byte leading: a byte of a binary value is only read by way of text.
    word = lambda n: F.conv(F.hex(F.substring(F.col("_bits"), n * 8 + 1, F.lit(8))), 16, -10).cast("long")
    blocks = blocks.select("_block", F.transform(F.sequence(F.lit(0), F.lit(511)), word).alias("_bits"))
    block, within = split(rows)
    number = F.col("_inside").cast("int")
    at = F.lit(56) - F.shiftright(number, 3) % 8 * 8 + number % 8
    bit = F.getbit(F.get("_bits", F.shiftright(number, 6)), at)
    return (
        rows.withColumn("_block", block).withColumn("_inside", within)
        .join(F.broadcast(blocks), "_block", "inner" if inside else "left")
        .where(bit == 1 if inside else F.coalesce(bit, F.lit(0)) == 0)
        .drop("_block", "_inside", "_bits")
    )
