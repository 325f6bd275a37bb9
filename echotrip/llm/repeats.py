"""Repeated passages by longest previous factors, kept to the depth that decides: ``length`` bytes.

A position's longest previous factor reaches ``length`` if its next ``length`` bytes also start at an
earlier position, that is if it is not the smallest position of its bucket in the suffix order at that depth. A whole
suffix array of the corpus would take several times its size in shuffles, so buckets are told by fingerprints and
found from coarse to fine:

1. Every start of ``length`` bytes has an anchor, the smallest hashed 32-byte piece among the first ``reach`` positions.
   Starts that share an anchor form a run (about two runs per ``reach`` bytes). Equal strings have
   equal anchors at equal places, and all strings of a run hold the core that begins at its anchor,
   so only runs whose core occurs twice can hold a repeat.
2. Runs of equal extent and bytes repeat as a whole. Where runs of one core differ, one run of each kind is opened into tiles
   of ``tile`` starts at fixed distances from the anchor, and the same is asked of tiles: a core that all its strings hold, then the whole.
3. Tiles that still differ are opened into single starts, ranked by fingerprints of all ``length`` bytes; the smallest position
   of a rank is the first occurrence.

``keep="first"`` removes bytes that an earlier string covers; ``keep="none"`` removes all occurrences. Positions are ordered by
document id, then byte. Fingerprints have 64 bits and are compared together with those of the cores they lie in. Texts go through a shuffle
only where a run is opened or a span is cut, as far as a bitmap of fixed size can tell.

Defined results: null text is empty; texts shorter than ``length`` lose nothing; of rows of one id that share a text, none is earlier
than another (they lose all with ``none`` and nothing to each other with ``first``), and each is returned; an empty table gives an empty
result; null ids are kept and come first. Cuts that split a character leave bytes that are not valid UTF-8: bytes are
exact, ``cut_text`` drops the broken character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrip.llm import arrays
from echotrip.llm.sift import with_likely
from echotrip.session import stage

PIECE = 32
POSITION_BITS = 31
CHUNK = 512 << 10  # bytes a task looks at together; longer texts are looked at in windows


@dataclass(frozen=True)
class Settings:
    length: int = 400
    reach: int = 192
    tile: int = 16

    @property
    def core(self) -> int:
        return self.length - self.reach + 1


RUNS = "id bigint, tag bigint, start int, extra int, lead int, core bigint, body bigint"
TILES = "id bigint, tag bigint, start int, extra int, core bigint, body bigint, ranks binary"
# The order of positions as one number: id, then byte.
PLACE = "cast(coalesce(id, -9223372036854775808) as decimal(38,0)) * 2147483648 + start"


def _anchors(roll: arrays.Rolling, size: int, reach: int) -> np.ndarray:
    """For every position the anchor among it and the reach - 1 next ones: the first of the smallest pieces."""
    at = np.arange(size - PIECE + 1)
    least = roll.of(at, at + PIECE) & ~np.uint64((1 << POSITION_BITS) - 1) | at.astype(np.uint64)
    span = 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    return (least & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)


def _windows(column: pa.Array, s: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in its text, bytes, offsets) of runs of short texts, and of windows of long ones.

    A window holds every string that starts in its first ``CHUNK`` bytes; windows begin at the same places in equal texts.
    """
    for lo, _, data, offsets in arrays.pieces(column, CHUNK):
        if len(data) <= 2 * CHUNK:
            yield lo, 0, data, offsets
            continue
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK + s.length - 1]
            yield lo, at, part, np.array([0, len(part)])


def _runs(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("id"), batch.column("tag")
            for lo, place, data, offsets in _windows(batch.column("text"), s):
                sizes = np.diff(offsets)
                long = np.flatnonzero(sizes >= s.length)
                if not len(long):
                    continue
                roll = arrays.Rolling(data)
                anchors = _anchors(roll, len(data), s.reach)
                counts = sizes[long] - s.length + 1
                first = np.concatenate([[0], np.cumsum(counts)])
                starts = np.arange(first[-1]) + np.repeat(offsets[long] - first[:-1], counts)
                anchor = anchors[starts]
                edge = np.ones(len(starts), bool)
                edge[1:] = anchor[1:] != anchor[:-1]
                edge[first[:-1]] = True
                begin = np.flatnonzero(edge)
                end = np.concatenate([begin[1:], [len(starts)]])
                i0, i1, a = starts[begin], starts[end - 1], anchor[begin]
                owner = np.searchsorted(offsets, i0, "right") - 1
                body = roll.of(i0, i1 + s.length) ^ arrays.mix((a - i0).astype(np.uint64))
                rows = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(rows),
                        tags.take(rows),
                        pa.array((i0 - offsets[owner] + place).astype(np.int32)),
                        pa.array((i1 - i0).astype(np.int32)),
                        pa.array((a - i0).astype(np.int32)),
                        pa.array(roll.of(a, a + s.core).view(np.int64)),
                        pa.array(body.view(np.int64)),
                    ],
                    names=["id", "tag", "start", "extra", "lead", "core", "body"],
                )

    return run


def _tiles(s: Settings):
    """Opened runs cut into tiles of starts whose distance from the anchor is t * tile to t * tile + tile - 1."""

    def cut(roll: arrays.Rolling, kinds: pa.StructArray, shift: int):
        start, extra, lead = (kinds.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "extra", "lead"))
        anchor = start + lead
        low, high = (lead - extra) // s.tile, lead // s.tile
        counts = high - low + 1
        run = np.repeat(np.arange(len(start)), counts)
        at = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = np.maximum(start[run], anchor[run] - at * s.tile - (s.tile - 1))
        last = np.minimum(start[run] + extra[run], anchor[run] - at * s.tile)
        begin = anchor[run] - at * s.tile + shift
        parent = kinds.field("core").to_numpy(zero_copy_only=False).view(np.uint64)[run]
        core = arrays.mix(roll.of(begin, begin + s.length - s.tile + 1) ^ arrays.mix(parent + at.astype(np.uint64)))
        body = roll.of(first + shift, last + shift + s.length) ^ arrays.mix((anchor[run] - first).astype(np.uint64))
        sizes = last - first + 1
        ends = np.concatenate([[0], np.cumsum(sizes)])
        every = np.repeat(first + shift - ends[:-1], sizes) + np.arange(ends[-1])
        ranks = roll.of(every, every + s.length)
        return first, last - first, core, body, [ranks[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def opened(batch: pa.RecordBatch):
        """Row, hashes, opened runs and where their text begins; of a long text window by window."""
        for lo, hi, data, offsets in arrays.pieces(batch.column("text"), CHUNK):
            if len(data) <= 2 * CHUNK:
                roll = arrays.Rolling(data)
                yield from ((row, roll, batch.column("kinds")[row].values, int(offsets[row - lo])) for row in range(lo, hi))
                continue
            kinds = batch.column("kinds")[lo].values
            start = kinds.field("start").to_numpy(zero_copy_only=False)
            for at in range(0, len(data), CHUNK):
                here = pa.array(np.flatnonzero((start >= at) & (start < at + CHUNK)))
                if len(here):
                    yield lo, arrays.Rolling(data[at : at + CHUNK + 2 * s.length]), kinds.take(here), -at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, roll, kinds, shift in opened(batch):
                if len(kinds):
                    first, extra, core, body, ranks = cut(roll, kinds, shift)
                    n = len(first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column("id")[row].as_py()] * n, pa.int64()),
                            pa.array([batch.column("tag")[row].as_py()] * n, pa.int64()),
                            pa.array(first.astype(np.int32)),
                            pa.array(extra.astype(np.int32)),
                            pa.array(core.view(np.int64)),
                            pa.array(body.view(np.int64)),
                            pa.array(ranks, pa.binary()),
                        ],
                        names=["id", "tag", "start", "extra", "core", "body", "ranks"],
                    )

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The starts of opened tiles, one row each."""
    for batch in batches:
        counts = batch.column("extra").to_numpy().astype(np.int64) + 1
        rows = pa.array(np.repeat(np.arange(len(counts)), counts))
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = batch.column("start").to_numpy().repeat(counts) + inside.astype(np.int32)
        ranks = np.frombuffer(b"".join(batch.column("ranks").to_pylist()), np.int64)
        taken = [batch.column(c).take(rows) for c in ("core", "id", "tag")]
        yield pa.RecordBatch.from_arrays([*taken, pa.array(start.astype(np.int32)), pa.array(ranks)], names=["core", "id", "tag", "start", "rank"])


def _twice(rows: DataFrame) -> DataFrame:
    """Rows whose core is not the only one of its kind."""
    cores = stage(rows.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores")
    return rows.join(cores, "core", "left_semi")


def _settle(rows: DataFrame, keep: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Spans of rows that repeat as a whole, and one row of each kind of the cores that have several."""
    kinds = rows.groupBy("core", "body").agg(F.count("*").alias("n"), F.min(F.expr(PLACE)).alias("least"))
    kinds = stage(kinds, "kinds")
    # What is staged joins as it is, and adaptive execution can split a common core's rows.
    several = kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = stage(several.select("core", F.lit(True).alias("several")), "several")
    named = stage(kinds.join(several, "core", "left").withColumn("mixed", F.coalesce("several", F.lit(False))), "named")
    known = rows.join(named.drop("several"), ["core", "body"]).withColumn("later", F.expr(f"{PLACE} <> least"))
    known = stage(known, "known")
    same = known.where("n > 1" if keep == "none" else "later")
    same = same.select("id", "tag", "start", (F.col("start") + F.col("extra") + s.length).alias("end"))
    return same, known.where("mixed and not later")


def marked_spans(docs: DataFrame, keep: str, s: Settings) -> DataFrame:
    """``docs`` (id, tag, text) -> id, tag, spans: begin and end of strings to remove, unmerged, one row per text that has any."""
    runs = stage(docs.select("id", "tag", "text").mapInArrow(_runs(s), RUNS), "runs")
    same, opened = _settle(stage(_twice(runs), "twice"), keep, s)
    # Repeated rows of one id and text open the same runs; once is enough.
    kinds = opened.groupBy("id", "tag").agg(F.collect_set(F.struct("start", "extra", "lead", "core")).alias("kinds"))
    kinds = stage(kinds, "opened")
    likely = with_likely(docs, kinds, ["id", "tag"]).where("likely").alias("d")
    texts = likely.join(kinds.alias("o"), F.expr("d.id <=> o.id and d.tag = o.tag")).select("d.id", "d.tag", "d.text", "o.kinds")
    tiles = stage(texts.mapInArrow(_tiles(s), TILES), "tiles")
    tile_same, tile_opened = _settle(stage(_twice(tiles), "twice"), keep, s)
    singles = tile_opened.select("core", "id", "tag", "start", "extra", "ranks")
    singles = stage(singles.mapInArrow(_single, "core bigint, id bigint, tag bigint, start int, rank bigint"), "singles")
    ranks = singles.groupBy("core", "rank").agg(F.count("*").alias("n"), F.min(F.expr(PLACE)).alias("least")).where("n > 1")
    ranks = stage(ranks.drop("n"), "ranks")
    again = singles.join(ranks, ["core", "rank"])
    if keep == "first":
        again = again.where(F.expr(f"{PLACE} <> least"))
    again = again.select("id", "tag", "start", (F.col("start") + s.length).alias("end"))
    spans = same.union(tile_same).union(again)
    return spans.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _with_spans(docs: DataFrame, spans: DataFrame, tag: str, id_col: str) -> DataFrame:
    """``docs`` with ``spans``; only texts that seem to have any are shuffled."""
    keyed = docs.withColumn("__id", F.col(id_col).cast("bigint")).withColumn("__tag", F.col(tag))
    wanted = spans.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans"))
    marked = with_likely(keyed, wanted, ["__id", "__tag"], "__likely")
    d, w = marked.where("__likely").alias("d"), wanted.alias("w")
    cut = d.join(w, F.expr("d.__id <=> w.__id and d.__tag = w.__tag"), "left")
    cut = cut.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("w.__spans").alias("__spans"))
    none = F.lit(None).cast(wanted.schema["__spans"].dataType).alias("__spans")
    return cut.union(marked.where("not __likely").select(*[F.col(f"`{c}`") for c in docs.columns], none))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the given ranges."""
    order = np.argsort(begin, kind="stable")
    begin, top = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > top[:-1]
    at = np.flatnonzero(new)
    return begin[at], top[np.concatenate([at[1:], [len(begin)]]) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_removed, n_spans, digests, rest, where = [], [], [], [], []
        spans = batch.column("spans")
        for row, text in enumerate(batch.column("text")):
            data = text.as_buffer() if text.is_valid else b""
            data = bytes(memoryview(data)) if data is not None else b""
            begin = end = np.zeros(0, np.int64)
            if spans[row].is_valid:
                both = spans[row].values
                begin, end = merged(both.field("start").to_numpy().astype(np.int64), both.field("end").to_numpy().astype(np.int64))
            kept = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
            n_removed.append(int((end - begin).sum()))
            n_spans.append(len(begin))
            digests.append(hashlib.sha256(kept).hexdigest())
            rest.append(kept)
            where.append([{"start": x, "end": y} for x, y in zip(begin.tolist(), end.tolist())])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("n_bytes"),
                pa.array(n_removed, pa.int64()),
                pa.array(n_spans, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(rest, pa.binary()),
                pa.array(where, kind),
            ],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"],
        )


CUT = (
    "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, "
    "removed array<struct<start: bigint, end: bigint>>"
)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "first",
    settings: Settings = Settings(),
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), removed (spans of bytes)."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("tag"), "text")
    spans = stage(marked_spans(rows, keep, settings), "spans")
    both = _with_spans(rows, spans, "tag", "id")
    both = both.select("id", "text", F.octet_length("text").cast("bigint").alias("n_bytes"), F.col("__spans").alias("spans"))
    return both.mapInArrow(_cut, CUT).withColumnRenamed("id", id_col)


def _replace(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                if not spans.is_valid or not text.is_valid:
                    texts.append(text.as_py())
                    continue
                data, fields = text.as_py().encode(), spans.values
                begin, end = merged(fields.field("start").to_numpy().astype(np.int64), fields.field("end").to_numpy().astype(np.int64))
                kept = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
                texts.append(kept.decode("utf-8", "ignore"))
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def cut_text(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "first", settings: Settings = Settings()
) -> DataFrame:
    """``docs``, all rows and columns, with repeats cut out of the text; a character cut in two goes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    spans = stage(marked_spans(rows.select("id", F.xxhash64("text").alias("tag"), "text"), keep, settings), "spans")
    both = _with_spans(docs.withColumn("__text_tag", F.xxhash64(text)), spans, "__text_tag", id_col).drop("__text_tag")
    return both.mapInArrow(_replace(docs.columns.index(text_col)), docs.schema)
