"""Integer vectors in chunks with a dictionary of values per dimension, for rounds of nearest-entry assignment.

A chunk is one row: some thousand vectors of one width as a code per dimension and vector, and for every dimension the distinct integers
that occur. A round tabulates, per dimension, the squared difference of each such integer to each entry; distances are gathers from
these tables, added over the dimensions. Chunks are written once and read in every round, so a lost executor costs its tasks only, and a task holds one chunk.

Integers are exact whatever their size: where 64 bits could overflow, the same tables hold Python integers. Sums leave a task as limbs of
40 bits, which Spark adds up, so no task or driver takes more than the entries' own size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 16_384
CELLS = 1 << 20
LIMB = 40
LONGEST = (1 << 63) - 1
CHUNK_SQL = "width int, n int, codes binary, sizes array<int>, vals binary, wide array<string>"
SUMS_SQL = "width int, cell int, limb int, part bigint"


def is_finite(vector: Column) -> Column:
    """Not null, and all components neither null nor NaN nor infinite."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly; ``scale`` is a power of two."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if (np.abs(scaled) < 2.0**62).all():
        return scaled.astype(np.int64)
    # From 2^53 on a double is an integer.
    exact = [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def _chunk(scale: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(keep)
            widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                size = max(1, min(ROWS, CELLS // max(width, 1)))
                for lo in range(0, len(rows), size):
                    at = pa.array(rows[lo : lo + size])
                    flat = vectors.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    table = _integers(flat.reshape(len(at), width), scale)
                    found = [np.unique(table[:, d], return_inverse=True) for d in range(width)]
                    codes = b"".join(c.astype(np.uint16).tobytes() for _, c in found)
                    values = [v for v, _ in found]
                    exact = table.dtype == object
                    one = lambda x, kind: pa.array([x], kind)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), batch.column(i).take(at)) for i in range(keep)],
                            one(width, pa.int32()),
                            one(len(at), pa.int32()),
                            one(codes, pa.binary()),
                            one([len(v) for v in values], pa.list_(pa.int32())),
                            one(b"" if exact else b"".join(v.tobytes() for v in values), pa.binary()),
                            one([str(x) for v in values for x in v.tolist()] if exact else None, pa.list_(pa.string())),
                        ],
                        names=[*batch.schema.names[:keep], "width", "n", "codes", "sizes", "vals", "wide"],
                    )

    return run


def chunks(vectors: DataFrame, scale: int) -> DataFrame:
    """``vectors`` (columns to keep, then one array<double> of finite components) in chunks; a kept column becomes an array."""
    *kept, _ = vectors.dtypes
    schema = "".join(f"`{name}` array<{kind}>, " for name, kind in kept) + CHUNK_SQL
    return vectors.mapInArrow(_chunk(scale, len(kept)), schema)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


@dataclass
class Chunk:
    codes: np.ndarray  # dimension, vector
    values: list[np.ndarray]

    def nearest(self, first: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of every vector's nearest entry (of equal ones the first), over the dimensions from ``first`` on."""
        width = entries.shape[1]
        values = self.values[first : first + width]
        most = max(map(largest, values), default=0) + largest(entries)
        kind = np.int64 if width * most * most <= LONGEST else object
        entries = entries.astype(kind)
        total = np.zeros((self.codes.shape[1], len(entries)), kind)
        for d in range(width):
            table = (values[d].astype(kind)[:, None] - entries[None, :, d]) ** 2
            total += table[self.codes[first + d]]
        near = total.argmin(axis=1).astype(np.int64)
        return near, total[np.arange(len(near)), near]

    def sums(self, first: int, width: int, near: np.ndarray, k: int) -> np.ndarray:
        """Per entry the sum of its vectors in every dimension, and their number, as Python integers."""
        out = np.zeros((k, width + 1), object)
        for d in range(width):
            values = self.values[first + d]
            if len(near) * largest(values) > LONGEST:
                values = values.astype(object)
            held = np.bincount(near * len(values) + self.codes[first + d], minlength=k * len(values)).reshape(k, len(values))
            out[:, d] = held.astype(values.dtype) @ values
        out[:, width] = np.bincount(near, minlength=k)
        return out


def read_chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Chunk]]:
    """Row, width and chunk of every row of ``batch``."""
    for row, width in enumerate(batch.column("width").to_pylist()):
        codes = np.frombuffer(batch.column("codes")[row].as_py(), np.uint16).reshape(width, batch.column("n")[row].as_py())
        wide = batch.column("wide")[row].as_py()
        values = np.frombuffer(batch.column("vals")[row].as_py(), np.int64) if wide is None else np.array([int(x) for x in wide], object)
        ends = np.cumsum([0, *batch.column("sizes")[row].as_py()])
        yield row, width, Chunk(codes, [values[a:b] for a, b in zip(ends, ends[1:])])


def _limbs(total: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Cell, limb number and value of every non-zero limb; a limb has its number's sign."""
    cells, limbs, parts = [], [], []
    for cell, x in enumerate(total.ravel().tolist()):
        rest, sign, limb = abs(x), -1 if x < 0 else 1, 0
        while rest:
            cells.append(cell)
            limbs.append(limb)
            parts.append(sign * (rest & ((1 << LIMB) - 1)))
            rest, limb = rest >> LIMB, limb + 1
    return cells, limbs, parts


Books = dict[int, np.ndarray]  # width -> (parts, entries, dimensions of a part)


def _sum_parts(books: Books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, width, chunk in read_chunks(batch):
                parts, k, size = books[width].shape
                total = totals.setdefault(width, np.zeros((parts, k, size + 1), object))
                for p in range(parts):
                    near, _ = chunk.nearest(p * size, books[width][p])
                    total[p] += chunk.sums(p * size, size, near, k)
        for width, total in totals.items():
            cells, limbs, parts = _limbs(total)
            columns = [([width] * len(cells), pa.int32()), (cells, pa.int32()), (limbs, pa.int32()), (parts, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], names=["width", "cell", "limb", "part"])

    return run


def move(chunked: DataFrame, books: Books) -> Books:
    """One round: vectors go to their nearest entries, which move to the floor of their mean; entries without any stay."""
    columns = ("width", "n", "codes", "sizes", "vals", "wide")
    sums = chunked.select(*columns).mapInArrow(_sum_parts(books), SUMS_SQL)
    totals = {w: np.zeros((*b.shape[:2], b.shape[2] + 1), object) for w, b in books.items()}
    for row in sums.groupBy("width", "cell", "limb").agg(F.sum("part").alias("part")).collect():  # a few times the books' size
        totals[row.width].reshape(-1)[row.cell] += row.part << (LIMB * row.limb)
    moved = {}
    for width, book in books.items():
        sums, counts = totals[width][..., :-1], totals[width][..., -1:]
        moved[width] = np.where(counts > 0, sums // np.where(counts > 0, counts, 1), book)
    return moved


def as_book(rows: list[list[float]], parts: int, scale: int) -> np.ndarray:
    """First entries of every part from whole vectors, as Python integers."""
    table = _integers(np.array(rows, np.float64), scale).astype(object)
    return table.reshape(len(rows), parts, table.shape[1] // parts).transpose(1, 0, 2)


def clipped(distances: np.ndarray) -> np.ndarray:
    return np.minimum(distances, LONGEST).astype(np.int64)


def total_as_long(column: str) -> Column:
    """Sum of a column of longs that may pass a long: then the largest long."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint")
