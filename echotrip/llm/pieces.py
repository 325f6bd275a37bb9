"""SentencePiece encoding and decoding by a word lattice.

A text gets a leading space, spaces become the mark U+2581, and units are runs of marks with the characters after them; no piece
crosses a unit (checked when the model is read). Frequent units are encoded relationally: all substrings of at most the longest piece's
length are exploded, equi-joined to the piece table, grouped by unit, and folded by a higher-order aggregate that keeps the
best path to every position. Single characters without a piece become byte pieces (or the unknown piece).

Viterbi on scores is right for unigram models. Merge (BPE) models have ranks for scores, and the sum of ranks does not give their encoding;
for them a step is allowed only if the merges of the two pieces' joined text give back these two pieces. An encoding
is that of the merges exactly if all its neighbours pass that test, and every position has one such path, so the same fold finds it.

Texts are encoded where they lie. The table of frequent units that goes to every task has at most ``table`` units of at most ``longest`` characters;
all other units are encoded in place, by the model's merges (the units of some megabytes together, round by round) or, if long, by the same
lattice and fold. Nothing but unit counts is shuffled. Words are cut, told apart and gathered as Arrow arrays; each different word of a slice is looked at once.

Defined results: null and empty texts have no pieces; repeated rows are encoded each; an empty table gives an empty result; U+2581 in a text
is read as a space; ids outside the model decode to nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrip.session import spread, stage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_COST = 10.0  # below the worst score
NO_PAIR = np.iinfo(np.int32).max
SHORT = 64
COUNTED = 800_000  # rows of words and counts that a task holds before it adds them up
CHUNK = 4 << 20  # bytes of text that a task cuts into words together
OWN_UNITS = 100_000  # units with odd characters, or long ones, whose ids a task remembers


@dataclass(frozen=True)
class Settings:
    table: int = 150_000
    longest: int = 64


@dataclass
class Model:
    """Pieces of a model file: text -> (id, score), byte pieces, and which characters always stand alone."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown: int
    merges: bool
    alone: str = ""
    width: int = 1
    worst: float = 0.0
    known: dict = field(default_factory=dict)

    def plain(self) -> tuple:
        """The fields as plain data, for a broadcast."""
        return self.pieces, self.byte_ids, self.unknown, self.merges, self.alone, self.width, self.worst

    def __post_init__(self) -> None:
        self.scores = {p: s for p, (_, s) in self.pieces.items()}
        self.ids = {p: i for p, (i, _) in self.pieces.items()}

    def merged(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging: the best-scored neighbours first, of equal ones the leftmost."""
        none, scores = float("-inf"), self.scores
        parts = list(text)
        pairs = [scores.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = scores.get(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = scores.get(parts[at - 1] + parts[at], none)
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether ``right`` may come after ``left`` ("" at the beginning of a unit)."""
        if not self.merges:
            return True
        key = (left, right)
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = self.merged(left + right) == ([left, right] if left else [right])
        return self.known[key]

    def ids_of(self, char: str) -> list[int]:
        found = self.pieces.get(char)
        if found is not None:
            return [found[0]]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def encode_unit(self, unit: str) -> list[int]:
        """One unit in place: short ones of a merge model by its merges, others by the same lattice and fold."""
        if self.merges and len(unit) <= SHORT:
            parts = self.merged(unit)
            ids = [self.ids.get(p, -1) for p in parts]
            return ids if -1 not in ids else [i for p in parts for i in self.ids_of(p)]
        return self.encode_long(unit)

    def encode_long(self, unit: str) -> list[int]:
        """The lattice and fold in place; its time grows with the unit's length, that of merging with the square."""
        best: list[tuple[float, int, str] | None] = [(0.0, 0, "")] + [None] * len(unit)
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - self.width), end):
                piece = unit[start:end]
                found = self.pieces.get(piece)
                if found is None and end - start > 1 or best[start] is None or not self.follows(best[start][2], piece):
                    continue
                score = best[start][0] + (found[1] if found is not None else self.worst - UNKNOWN_COST)
                if best[end] is None or score > best[end][0]:
                    best[end] = (score, start, piece)
        out, end = [], len(unit)
        while end > 0:
            out.append(best[end][2])
            end = best[end][1]
        return [i for piece in reversed(out) for i in ([self.pieces[piece][0]] if piece in self.pieces else self.ids_of(piece))]


def read_model(path: str = MODEL, merges: bool = True) -> Model:
    """Reads a model file on the driver. ``merges``: whether it is a merge (BPE) model."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    n = file.get_piece_size()
    special = lambda i: file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i)
    pieces = {file.id_to_piece(i): (i, float(file.get_score(i))) for i in range(n) if not special(i)}
    byte_ids = [i for i in range(n) if file.is_byte(i)]
    if len(byte_ids) not in (0, 256):
        raise ValueError("a model has all byte pieces or none")
    byte_ids.sort(key=lambda i: int(file.id_to_piece(i)[1:-1], 16))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece crosses words")
    long = "".join(p for p in pieces if len(p) > 1)
    alone = "".join(c for c in "\n\t" if c not in long)
    width = max(map(len, pieces), default=1)
    return Model(pieces, byte_ids, file.unk_id(), merges, alone, width, min((s for _, s in pieces.values()), default=0.0))


def _cutter(alone: str):
    inner = re.escape(MARK + alone)
    return re.compile(f"{MARK}+[^{inner}]*|[^{inner}]+" + (f"|[{re.escape(alone)}]" if alone else "")).findall


def _units(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """Runs of whole texts of about ``CHUNK`` bytes, at least one text each."""
    texts = column.cast(pa.large_string())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def _count(alone: str, longest: int):
    """Words after a single space (or at the beginning), which are most of all units; others are not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.Table] = []
        for batch in batches:
            for texts in _slices(batch.column(0)):
                words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ").flatten()
                seen.append(pa.Table.from_arrays(pc.value_counts(words).flatten(), names=["unit", "n"]))
                if sum(map(len, seen)) > COUNTED:
                    seen = [added(seen)]
                    if len(seen[0]) > COUNTED // 2:
                        yield from flush(seen[0])
                        seen = []
        if seen:
            yield from flush(added(seen))

    def added(seen: list[pa.Table]) -> pa.Table:
        both = pa.concat_tables(seen).group_by("unit", use_threads=False).aggregate([("n", "sum")])
        return both.select(["unit", "n_sum"]).rename_columns(["unit", "n"])

    def flush(seen: pa.Table) -> list[pa.RecordBatch]:
        sizes = pc.utf8_length(seen["unit"])
        kept = pc.and_(pc.greater(sizes, 0), pc.less(sizes, longest))
        for char in alone + MARK:
            kept = pc.and_not(kept, pc.match_substring(seen["unit"], char))
        seen = seen.filter(kept)
        units = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), seen["unit"], pa.scalar("", pa.large_string()))
        return pa.table({"unit": units.cast(pa.string()), "n": seen["n"]}).to_batches()

    return run


def frequent_units(docs: DataFrame, text_col: str, model: Model, s: Settings) -> DataFrame:
    """The units that occur most often in all documents, at most ``table`` of them: all with at least so many occurrences.

    They are only a table of ready encodings; all others are encoded in place with the same result.
    """
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(model.alone, s.longest), "unit string, n bigint")
    counts = stage(counted.groupBy("unit").agg(F.sum("n").alias("n")), "units")
    # Powers of two of the count are a table of at most 64 rows.
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect()
    least, held = 64, 0
    for row in sizes:
        if held + row["count"] > s.table:
            break
        least, held = row["level"], held + row["count"]
    return counts.where(F.col("n") >= F.lit(2.0) ** least).select("unit")


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(p, i, s) for p, (i, s) in model.pieces.items()]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def lattice(units: DataFrame, pieces: DataFrame, model: Model) -> DataFrame:
    """unit and its edges, by end: every substring that is a piece, and single characters that are none."""
    width, chars = model.width, F.length("unit")
    cut = units.withColumn("start", F.explode(F.sequence(F.lit(0), chars - 1)))
    cut = cut.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(width), chars - F.col("start")))))
    cut = cut.withColumn("piece", F.substr("unit", F.col("start") + 1, F.col("size")))
    joined = cut.join(F.broadcast(pieces), "piece", "left").where("id is not null or size = 1")
    edge = F.struct(
        (F.col("start") + F.col("size")).alias("end"),
        "start",
        "piece",
        F.coalesce("id", F.lit(-1)).alias("id"),
        F.coalesce("score", F.lit(model.worst - UNKNOWN_COST)).alias("score"),
    )
    return joined.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


STEP = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("score", pa.float64()), ("id", pa.int32()), ("ids", pa.list_(pa.int32())), ("after", pa.list_(pa.int32()))])))
STEP_SQL = "array<array<struct<start: int, score: double, id: int, ids: array<int>, after: array<int>>>>"


def _allowed(shared):
    """Edges by end, each with the ids it stands for and those that may precede it (-2: the beginning)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            lists, out = batch.column("edges"), []
            flat = lists.flatten()
            ends, starts, texts, ids, scores = (flat.field(c).to_pylist() for c in ("end", "start", "piece", "id", "score"))
            stop = 0
            for n in lists.value_lengths().to_pylist():
                ending: dict[int, list[tuple[int, str]]] = {0: [(-2, "")]}
                steps: list[list[dict]] = [[] for _ in range(ends[stop + n - 1])]
                for k in range(stop, stop + n):
                    piece = texts[k]
                    after = [i for i, before in ending.get(starts[k], ()) if model.follows(before, piece)]
                    ending.setdefault(ends[k], []).append((ids[k], piece))
                    if after:
                        own = [ids[k]] if ids[k] >= 0 else model.ids_of(piece)
                        steps[ends[k] - 1].append({"start": starts[k], "score": scores[k], "id": ids[k], "ids": own, "after": after})
                out.append(steps)
                stop += n
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(out, STEP)], names=["unit", "steps"])

    return run


def fold(edges: Column, size: Column) -> Column:
    """Ids of the best path: for each end in turn, the best allowed edge after the best path to its start.

    ``edges`` holds one array of edges for every end.
    """
    path = "struct<score: double, last: int, ids: array<int>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-2).alias("last"), F.array().cast("array<int>").alias("ids")).cast(path))

    def step(paths: Column, end: Column) -> Column:
        here = F.filter(F.get(edges, end - 1), lambda e: F.array_contains(e["after"], F.get(paths, e["start"])["last"]))
        reached = F.transform(
            here,
            lambda e: F.struct(
                (F.get(paths, e["start"])["score"] + e["score"]).alias("score"),
                e["id"].alias("last"),
                F.concat(F.get(paths, e["start"])["ids"], e["ids"]).alias("ids"),
            ).cast(path),
        )
        return F.concat(paths, F.array(F.array_max(reached)))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), size), first, step), -1)["ids"]


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """unit, ids, by the relational lattice."""
    spark = units.sparkSession
    shared = spark.sparkContext.broadcast(model.plain())
    # Little data, much work: as many tasks as the session has shuffle partitions.
    edges = lattice(spread(units, "unit"), piece_table(spark, model), model)
    kind = "array<struct<end: int, start: int, piece: string, id: int, score: double>>"
    edges = edges.select("unit", F.col("edges").cast(kind).alias("edges"))
    steps = edges.mapInArrow(_allowed(shared), f"unit string, steps {STEP_SQL}")
    return steps.select("unit", fold(F.col("steps"), F.length("unit")).alias("ids"))


def _blobs(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of ids as bytes, so that Arrow can gather them."""
    ends = 4 * np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(np.int32))])


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)


def _odd(texts: pa.Array) -> pa.Array:
    """Texts whose words can't be told by single spaces."""
    odd = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
    return pc.or_(odd, pc.match_substring(texts, MARK))


@dataclass
class Merges:
    """The merges of a model as arrays, for many units at once: symbols are pieces, and characters that are only part of pieces."""

    chars: np.ndarray  # code points, ascending
    of_char: np.ndarray
    ids: np.ndarray  # id of a symbol; -1: no piece
    pairs: np.ndarray  # left symbol * number of symbols + right one, ascending
    whole: np.ndarray  # symbol that a pair gives
    rank: np.ndarray  # place of its score, best first; equal scores have equal ranks

    @staticmethod
    def of(model: Model) -> Merges:
        names = list(dict.fromkeys([*model.pieces, *"".join(model.pieces)]))
        symbol = {p: k for k, p in enumerate(names)}
        splits = [(symbol.get(p[:k]), symbol.get(p[k:]), symbol[p]) for p in model.pieces for k in range(1, len(p))]
        found = np.array([x for x in splits if x[0] is not None and x[1] is not None], np.int64).reshape(-1, 3)
        found = found[np.argsort(found[:, 0] * len(names) + found[:, 1])]
        scores = np.array([model.scores.get(p, 0.0) for p in names])
        _, rank = np.unique(-scores[found[:, 2]], return_inverse=True)
        # Both tables end with an entry that nothing equals, so that none is empty.
        single = sorted((ord(c), k) for c, k in symbol.items() if len(c) == 1)
        chars, of_char = np.array([*single, (1 << 62, -1)], np.int64).T
        ids = np.array([model.ids.get(p, -1) for p in names], np.int32)
        pairs = np.append(found[:, 0] * len(names) + found[:, 1], 1 << 62)
        return Merges(chars, of_char, ids, pairs, np.append(found[:, 2], -1).astype(np.int32), np.append(rank, NO_PAIR).astype(np.int32))

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``pairs``, and whether the pair is there; -1 stands for no symbol."""
        key = left.astype(np.int64) * len(self.ids) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return at, (self.pairs[at] == key) & (left >= 0) & (right >= 0)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, there = self._pair(left, right)
        return np.where(there, self.rank[at], NO_PAIR)

    def merged(self, parts: np.ndarray) -> np.ndarray:
        """Rows of symbols, filled with -1 at the end, by ``Model.merged``: in every round each row's best pair, the leftmost of equal ones."""
        out, rows = np.full(parts.shape, -1, np.int32), np.arange(len(parts))
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        while len(rows) and ranks.shape[1]:
            best = ranks.argmin(axis=1)
            left = ranks[np.arange(len(rows)), best] == NO_PAIR
            out[rows[left], : parts.shape[1]] = parts[left]
            rows, parts, ranks, best = rows[~left], parts[~left], ranks[~left], best[~left]
            every, width = np.arange(len(rows)), parts.shape[1]
            parts[every, best] = self.whole[self._pair(parts[every, best], parts[every, best + 1])[0]]
            at = np.arange(width - 1)
            parts = np.take_along_axis(parts, at + (at > best[:, None]), 1)
            ranks = np.take_along_axis(ranks, at[:-1] + (at[:-1] >= best[:, None]), 1)
            for k in (best - 1, best):
                some = np.flatnonzero((k >= 0) & (k < width - 2))
                ranks[some, k[some]] = self._ranks(parts[some, k[some]], parts[some, k[some] + 1])
        out[rows, : parts.shape[1]] = parts
        return out

    def encode(self, units: list[str], single: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units side by side, and how many each has; long ones and those with other characters by ``single``."""
        sizes = np.array([len(u) for u in units], np.int64)
        first = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        symbols = np.where(self.chars[at] == codes, self.of_char[at], -1).astype(np.int32)
        symbols = np.concatenate([symbols, np.full(SHORT, -1, np.int32)])
        counts, found, low = np.zeros(len(units), np.int64), [], 0
        done = np.zeros(len(units), bool)
        for width in (4, 8, 12, 16, 24, 32, SHORT):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            inside = np.arange(width) < sizes[rows, None]
            parts = np.where(inside, symbols[first[rows, None] + np.arange(width)], -1)
            good = ((parts >= 0) == inside).all(axis=1)
            rows, parts = rows[good], self.merged(parts[good])
            ids = np.where(parts >= 0, self.ids[parts], 0)
            good = (ids >= 0).all(axis=1)
            rows, parts, ids = rows[good], parts[good], ids[good]
            done[rows], counts[rows] = True, (parts >= 0).sum(axis=1)
            found.append((rows, ids, parts >= 0))
        others = np.flatnonzero(~done)
        lists = [single(units[k]) for k in others.tolist()]
        counts[others] = [len(x) for x in lists]
        start = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for rows, ids, there in found:
            out[(start[rows, None] + np.arange(ids.shape[1]))[there]] = ids[there]
        for k, x in zip(others.tolist(), lists):
            out[start[k] : start[k] + len(x)] = x
        return out, counts


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """id and ids of every row."""
    s, spark = settings, docs.sparkSession
    frequent = stage(encode_units(frequent_units(docs, text_col, model, s), model), "encoded")
    found = frequent.select("unit", "ids").toArrow().combine_chunks()  # at most ``table`` short rows
    words, ids = found.column("unit").combine_chunks(), found.column("ids").combine_chunks()
    shared = spark.sparkContext.broadcast(
        (
            pc.utf8_slice_codeunits(words, 1).cast(pa.large_string()),
            _blobs(ids.flatten().to_numpy(), ids.value_lengths().to_numpy()),
            model.plain(),
            Merges.of(model) if model.merges else None,
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, spelt, plain, merges = shared.value
        model = Model(*plain)
        cut = _cutter(model.alone)
        own: dict[str, list[int]] = {}

        def single(unit: str) -> list[int]:
            ids = own.get(unit)
            if ids is None:
                if len(own) > OWN_UNITS:
                    own.clear()
                ids = own[unit] = model.encode_unit(unit)
            return ids

        def units_of(word: str) -> list[str]:
            if word[:1] == " ":
                return [word[1:]]
            if word[:1] == "\n":
                return ["\n", *cut(word[1:])]
            return cut(MARK + word) if "\t" in word else [MARK + word]

        def spell(words: list[str]) -> pa.Array:
            lists = [units_of(w) for w in words]
            units = [u for x in lists for u in x]
            ids, sizes = merges.encode(units, single) if merges else _joined([single(u) for u in units])
            first = np.concatenate([[0], np.cumsum(sizes)])
            return _blobs(ids, np.diff(first[np.cumsum([0] + [len(x) for x in lists])]))

        def plain_words(texts: pa.Array) -> pa.Array:
            """Every part after a space is a word; the first part of a further line comes with its line break and has no mark."""
            return pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")

        def no_words(texts: pa.Array) -> pa.Array:
            return pa.nulls(len(texts), pa.list_(pa.large_string()))

        def odd_words(texts: pa.Array) -> pa.Array:
            """The same of texts with marks or several spaces; after a space that begins it, a word is a unit as it is."""
            lists = [cut(_units(t)) for t in texts.to_pylist()]
            return pa.array([[u[1:] if u[0] == MARK and u[1:2] != "\n" else " " + u for u in x] for x in lists], pa.list_(pa.large_string()))

        def encoded(lists: pa.Array) -> pa.Array:
            words = lists.flatten().dictionary_encode()
            at = pc.index_in(words.dictionary, value_set=known)
            rare = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
            place[rare] = len(known) + np.arange(len(rare))
            ready = pa.concat_arrays([spelt, spell(words.dictionary.take(pa.array(rare)).to_pylist())])
            ready = ready.take(pa.array(place[words.indices.to_numpy()]))
            ends = np.frombuffer(ready.buffers()[1], np.int64)[: len(ready) + 1] // 4
            count = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            data = ready.buffers()[2]
            ids = np.frombuffer(data, np.int32)[: ends[-1]] if ends[-1] else np.zeros(0, np.int32)
            return pa.ListArray.from_arrays(pa.array(ends[count].astype(np.int32)), pa.array(ids))

        for batch in batches:
            lo = 0
            for texts in _slices(batch.column("text")):
                names = batch.column("id").slice(lo, len(texts))
                lo += len(texts)
                blank = pc.fill_null(pc.equal(texts, ""), True)
                odd = pc.and_not(pc.fill_null(_odd(texts), False) if "\n" in model.alone else texts.is_valid(), blank)
                for here, words in ((blank, no_words), (odd, odd_words), (pc.invert(pc.or_(blank, odd)), plain_words)):
                    if pc.any(here).as_py():
                        yield pa.RecordBatch.from_arrays([names.filter(here), encoded(words(texts.filter(here)))], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids."""
    spell = {i: p.replace(MARK, " ").encode() for p, (i, _) in model.pieces.items()}
    spell |= {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
    table = pa.array([spell.get(i, b"") for i in range(max(spell, default=-1) + 1)], pa.large_binary())
    shared = encoded.sparkSession.sparkContext.broadcast(table)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                lists = part.column(at)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                there = (ids >= 0) & (ids < len(table))
                count = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                inside = np.concatenate([[0], np.cumsum(there)])[count]
                spelt = table.take(pa.array(ids[there].astype(np.int64)))
                ends = np.frombuffer(spelt.buffers()[1], np.int64)[inside].tolist() if len(spelt) else [0] * len(count)
                data = memoryview(spelt.buffers()[2] or b"")
                texts = [str(data[x:y], "utf-8", "replace").removeprefix(" ") for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text_col])

    schema = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])
    return encoded.mapInArrow(run, schema)
