"""Vector compression: a vector becomes one code per part, by codebooks that are learnt with value dictionaries.

Components become integers and vectors are cut into equal parts. For every dimension the squared differences of each distinct integer to
all entries of its part's codebook are tabulated; a part's distances are gathers by dictionary code, added over its dimensions
(``dictionaries``). Codebooks begin as the parts of the vectors of smallest ids and move to the floor of their parts' mean for some rounds. All
arithmetic is exact, so the result does not depend on how rows lie.

Defined results: null vectors and those with null or non-finite components are left out, and so are vectors whose length is no multiple of the
number of parts (one without components has the first entry everywhere); vectors of different lengths have codebooks of their own; every row
counts, also rows of one id (the smaller vector begins
first); null ids come after all others; fewer vectors than entries give as many entries; errors and sums beyond a long become the largest long;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotrip.llm.dictionaries import Books, as_book, chunks, clipped, is_finite, move, read_chunks
from echotrip.session import stage


@dataclass(frozen=True)
class Settings:
    scale: int = 4096  # a power of two
    parts: int = 8
    entries: int = 16  # at most 256
    rounds: int = 6


@dataclass(frozen=True)
class Codes:
    coded: DataFrame  # kept columns, width, code (one byte a part), error (squared distances over all parts)
    books: Books  # width -> part, entry, dimension of the part; integers

    def table(self) -> DataFrame:
        """width, part, entry, components (integers as text: they may pass a long)."""
        rows = [
            (width, p, j, [str(x) for x in entry])
            for width, book in self.books.items()
            for p, entries in enumerate(book.tolist())
            for j, entry in enumerate(entries)
        ]
        return self.coded.sparkSession.createDataFrame(rows, "width int, part int, entry int, components array<string>")


def _code(books: Books, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, width, chunk in read_chunks(batch):
                parts, _, size = books[width].shape
                found = [chunk.nearest(p * size, books[width][p]) for p in range(parts)]
                codes = np.stack([near for near, _ in found], axis=1).astype(np.uint8)
                error = sum(distance.astype(object) for _, distance in found)
                columns = [batch.column(i)[row].values for i in range(keep)]
                columns += [pa.array(np.full(len(codes), width, np.int32)), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(clipped(error))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:keep], "width", "code", "error"])

    return run


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), settings: Settings = Settings()
) -> Codes:
    """Codes of every vector, with its id and the columns ``keep``."""
    s = settings
    if not 0 < s.entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    named = rows.select(F.col(id_col).alias("k0"), *[F.col(c).alias(f"k{i + 1}") for i, c in enumerate(keep)], F.col(vector_col).cast("array<double>").alias("vector"))
    named = named.where(is_finite(F.col("vector")) & (F.size("vector") % s.parts == 0))
    chunked = stage(chunks(named, s.scale), "chunks")
    order = Window.partitionBy("width").orderBy(F.asc_nulls_last("k0"), "vector")
    ranked = named.select("k0", "vector", F.size("vector").alias("width")).withColumn("place", F.row_number().over(order))
    begin: dict[int, list] = {}
    for row in ranked.where(F.col("place") <= s.entries).orderBy("width", "place").collect():  # a codebook's entries per width
        begin.setdefault(row.width, []).append(row.vector)
    books = {width: as_book(vectors, s.parts, s.scale) for width, vectors in begin.items()}
    for _ in range(s.rounds if books else 0):
        books = move(chunked, books)
    kept = named.dtypes[:-1]
    schema = "".join(f"{name} {kind}, " for name, kind in kept) + "width int, code binary, error bigint"
    coded = stage(chunked.mapInArrow(_code(books, len(kept)), schema), "codes")
    names = [id_col, *keep]
    return Codes(coded.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "width", "code", "error"), books)


def decoded(codes: Codes, scale: int = Settings.scale) -> DataFrame:
    """Every coded row with ``approximation``, the entries of its code side by side, at the vectors' own scale."""
    entries = codes.table().groupBy("width").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("part", "entry"), "components"))).alias("book"))
    joined = codes.coded.join(F.broadcast(entries), "width")  # one codebook per width
    parts = F.sequence(F.lit(0), F.octet_length("code") - 1)
    byte = lambda p: F.conv(F.hex(F.substr("code", p + 1, F.lit(1))), 16, 10).cast("int")
    whole = F.flatten(F.transform(parts, lambda p: F.element_at("book", F.struct(p.alias("part"), byte(p).alias("entry")))))
    return joined.select(*codes.coded.columns, F.transform(whole, lambda x: x.cast("double") / scale).alias("approximation"))
