"""Bitmaps of a fixed size: whether a hash may be in a set that itself may have any size.

A bitmap answers yes for every member and for a few others.  It is made by the executors in
blocks, its size is given by its bits and not by the data, and it is small enough to send.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 16  # bits of a place within its block


def place(hashes: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash."""
    return F.shiftrightunsigned(hashes, 64 - bits)


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, packed in bytes, from a column `place` of numbers below 2**bits."""

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        flags = np.zeros(1 << BLOCK, np.uint8)
        flags[rows["inside"].to_numpy()] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bytes": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    blocks = (
        places.select(F.shiftright("place", BLOCK).alias("block"), F.col("place").bitwiseAND(F.lit((1 << BLOCK) - 1)).alias("inside"))
        .distinct().groupBy("block").applyInArrow(pack, "block long, bytes binary").toArrow()  # the bitmap's size at most
    )
    out = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
    size = 1 << (BLOCK - 3)
    for block, packed in zip(blocks["block"].to_pylist(), blocks["bytes"].to_pylist(), strict=True):
        out[block * size:(block + 1) * size] = np.frombuffer(packed, np.uint8)[:len(out) - block * size]
    return out


def among(bitmap_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bit of each hash (uint64) is set."""
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
