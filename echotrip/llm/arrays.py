"""Array kernels over a batch of texts: words, polynomial hashes, mixing. They run inside tasks.

A batch is one byte array plus offsets; documents of a batch are handled a few megabytes at a
time, so memory follows ``CHUNK_BYTES`` (or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
# ASCII white space \x20 \x09-\x0D, as the word pattern [^\x20\x09-\x0D]+ has it.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more entry than texts). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts of about ``limit`` bytes, at least one text each."""
    if not len(column):
        return
    data, offsets = texts_of(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads 64 bits over all 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any byte range of ``data``, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers[:n], out=self.sums[1:])
        self.undo = np.full(n + 1, INVERSE, np.uint64)
        self.undo[0] = 1
        np.cumprod(self.undo, out=self.undo)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - begin).astype(np.uint64)
        return mix((self.sums[end] - self.sums[begin]) * self.undo[begin] + length * np.uint64(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of every word; words never cross texts."""
    inside = ~WHITE[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:] = ~inside[:-1]
    last[:-1] = ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = True
    last[edges - 1] = True
    begin = np.flatnonzero(inside & first)
    end = np.flatnonzero(inside & last) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def sequence_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring entries (len - width + 1 of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n]
    return mix(out)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marked bytes of every text."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur twice or more, and which have an equal one before them."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later
