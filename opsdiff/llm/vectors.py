"""What the operators on embeddings share: vectors of Arrow batches, Hilbert order, blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
BLOCK_BYTES = 4 << 20  # of vectors as doubles; many dimensions make blocks of fewer rows


def dimensions(rows: DataFrame, column: str = "embedding") -> int:
    """The length most vectors have, of equally frequent ones the smaller; 0 if there are none."""
    sizes = rows.where(F.size(column) > 0).groupBy(F.size(column).alias("n")).agg(F.count("*").alias("times"))
    most = sizes.orderBy(F.desc("times"), "n").first()
    return most["n"] if most else 0


def finite(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, doubles): the vectors of a batch that have dims entries, all of them finite."""
    whole = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(whole)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    found = flat.reshape(len(whole), dims)
    good = np.isfinite(found).all(axis=1)
    return whole[good], found[good]


def block_rows(dims: int) -> int:
    return int(np.clip(BLOCK_BYTES // (8 * max(dims, 1)), 32, BLOCK_ROWS))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve, int64, of points whose coordinates are whole numbers below 2**bits.

    Skilling's transposed form: coordinates are turned bit by bit from the highest, Gray
    coded, and the bits of all coordinates are interleaved.  dims * bits is at most 63.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        below = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def in_order(rows: DataFrame, count: int, dims: int, *by: str) -> DataFrame:
    """Rows in ranges of the columns, some blocks to a range, sorted within."""
    return rows.repartitionByRange(max(1, count // (4 * block_rows(dims))), *by).sortWithinPartitions(*by)


def stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, pa.Table]]:
    """(label, rows): consecutive rows with one label, the first column, up to size of them."""
    held: list[pa.RecordBatch] = []
    rows, name = 0, None
    for batch in batches:
        labels = batch.column(0)
        codes = labels.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            label = labels[start].as_py()
            if held and label != name:
                yield name, pa.Table.from_batches(held)
                held, rows = [], 0
            name = label
            while start < end:
                taken = min(size - rows, end - start)
                held.append(batch.slice(start, taken))
                rows, start = rows + taken, start + taken
                if rows == size:
                    yield name, pa.Table.from_batches(held)
                    held, rows = [], 0
    if held:
        yield name, pa.Table.from_batches(held)


def packed(rows: DataFrame, key: Column, size: int, by: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """(<by>, pack, <columns as lists>): small rows collected in packs of about size, by a hash of key.

    Counts the rows, so that a pack holds about size of them however many there are.
    """
    packs = max(1, -(-rows.count() // size))
    one = F.struct(*[c.alias(name) for name, c in columns.items()])
    listed = rows.groupBy(*by, F.pmod(F.xxhash64(key), F.lit(packs)).alias("pack")).agg(F.collect_list(one).alias("all"))
    return listed.select(*by, "pack", *[F.col("all").getField(name).alias(name) for name in columns])
