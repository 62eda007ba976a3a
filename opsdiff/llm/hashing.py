"""Hashes of words and of runs of words, for whole batches of texts at once.

All bytes of a batch are taken together.  With prefix sums of byte codes times powers of an
odd number, modulo 2**64, the hash of any stretch is one subtraction and one product, so
no word becomes an object.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from opsdiff.llm.common import slices

BATCH_BYTES = 512 << 10  # of texts hashed at once: some fifty times as much is held meanwhile
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """The words of some texts: row, first byte and byte after the last, hash."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: int
    sums: np.ndarray
    inverse: np.ndarray

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of bytes start to end."""
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64))

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def byte_table(separators: bytes) -> np.ndarray:
    """For each byte whether it belongs to a word."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


SPACES = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
# Letters and digits, and every byte of a character beyond ASCII.
LETTERS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def words(text: pa.Array, inside: np.ndarray = SPACES, latin: bool = False) -> Words:
    """Words of string texts, A-Z folded; a null text has none.  No word runs over two texts.

    latin: the letters À to Þ are folded, too, which UTF-8 writes as one byte and a second.
    """
    with np.errstate(over="ignore"):
        text = text.cast(pa.string())
        n = len(text)
        buffers = text.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[text.offset:text.offset + n + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        data = _FOLD[data]
        if latin and len(data):
            second = (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
            second[1:] &= data[:-1] == 0xC3
            second[0] = False
            data[second] += 0x20
        mask = inside[data]
        if text.null_count:  # bytes below a null are undefined
            for r in np.flatnonzero(text.is_null().to_numpy(zero_copy_only=False)):
                mask[offsets[r]:offsets[r + 1]] = False
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], mask])
        after = np.concatenate([mask, [False]])
        start = np.flatnonzero(after & (~before | edge))
        end = np.flatnonzero(before & (~after | edge))
        row = np.searchsorted(offsets, start, "right") - 1
        powers, inverse = _powers(len(data) + 1, _P), _powers(len(data) + 1, _INVERSE)
        codes = mix(data.astype(np.uint64) + np.uint64(1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1], dtype=np.uint64)])
        found = Words(data, row, start, end, np.zeros(0, np.uint64), n, sums, inverse)
        found.hash = found.stretch(start, end)
        return found


def runs(found: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of the first word in all words, hash) of all runs of k words of one text.

    short: a text of 1 to k-1 words gives one run, of all its words.
    """
    with np.errstate(over="ignore"):
        h, row = found.hash, found.row
        n = len(h) - k + 1
        first = np.flatnonzero(row[:n] == row[k - 1:]) if n > 0 else np.zeros(0, np.int64)
        out = np.full(len(first), np.uint64(k))
        for j in range(k):
            out = mix(out * np.uint64(_P) + h[first + j])
        rows, places, hashes = row[first], first, out
        if short:
            counts = found.per_row()
            firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
            few = np.flatnonzero((counts > 0) & (counts < k))
            out = counts[few].astype(np.uint64)
            for j in range(k - 1):
                there = counts[few] > j
                out[there] = mix(out[there] * np.uint64(_P) + h[firsts[few[there]] + j])
            rows = np.concatenate([rows, few])
            places = np.concatenate([places, firsts[few]])
            hashes = np.concatenate([hashes, out])
        return rows, places, hashes


def distinct(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row and then hash."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def lists(row: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.ListArray:
    """One list a row from values sorted by row."""
    cuts = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    flat = pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind)
    return pa.ListArray.from_arrays(pa.array(cuts), flat)


def parts(batches: Iterator[pa.RecordBatch], column: int, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of a column take up to so many bytes, one row at least."""
    for batch in batches:
        yield from slices(batch, column, size)
