"""Packing documents into training sequences, balanced by attention cost.

A piece of n tokens costs n + n^2 / (6 * hidden) units: the linear part of a transformer layer against its attention, which grows with the
square of a piece that attends to itself only. Whole sequences are cut off long documents first. What is left of the documents is taken in
descending order, and each goes to the sequence of lowest cost that has room for it; where none has, the roomiest takes as much as it can and
the rest goes on to the next. Sequences of a block have together just the room that its pieces need: as many whole ones as fit, and
one of each power of two that the remainder is made of, so nothing is padded.

A block is about ``block`` tokens of one task, in the order they are read. No token is shuffled, and a task is on its own: if it is
lost, it is done again from its input, and it makes whole sequences. Sequence numbers are the task's number times 2^33 plus a running number.
Very long texts are encoded in slices that begin at a space or line break after an ASCII letter or digit, where this vocabulary's tokens never reach across.

Defined results: null and empty texts are the end token alone; repeated rows and rows with a null id are packed each; ties go to the
piece read first and the lowest sequence; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, cost double, capacity int"
BREAK = re.compile(r"(?<=[A-Za-z0-9])[ \n]")


@dataclass(frozen=True)
class Settings:
    length: int = 2048  # of a sequence, in tokens; a power of two
    end: int = 1  # token after every document
    hidden: int = 1024  # width of the model, for the share of attention in the cost
    block: int = 1 << 20  # tokens packed together
    slice: int = 1 << 18  # characters encoded at once
    vocabulary: str = "byte_bpe_50k.json"
    ranks: str = "byte_bpe_50k.tiktoken"
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)


def cost_of(n, hidden: int):
    return n + n * n / (6.0 * hidden)


def slices(text: str, limit: int) -> list[str]:
    """``text`` in parts of about ``limit`` characters (more only without any break), which encode as they do together."""
    out, begin = [], 0
    while len(text) - begin > limit:
        found = BREAK.search(text, begin + limit)
        if found is None:
            break
        out.append(text[begin : found.start()])
        begin = found.start()
    return [*out, text[begin:]]


def room(total: int, length: int) -> np.ndarray:
    """Sizes of the sequences for ``total`` tokens: whole ones, then the powers of two of the rest."""
    whole, rest = divmod(total, length)
    return np.array([length] * whole + [1 << b for b in reversed(range(length.bit_length())) if rest >> b & 1], np.int64)


def assign(sizes: np.ndarray, capacities: np.ndarray, hidden: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start, length, sequence, offset) of every part; ``sizes`` add up to ``capacities``."""
    left, cost = capacities.copy(), np.zeros(len(capacities))
    out = []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        start, rest = 0, int(sizes[piece])
        while rest:
            best = int(np.where(left >= rest, cost, np.inf).argmin())
            if left[best] < rest:
                best = int(np.where(left == left.max(), cost, np.inf).argmin())
            part = min(rest, int(left[best]))
            out.append((piece, start, part, best, int(capacities[best] - left[best])))
            left[best] -= part
            cost[best] += cost_of(part, hidden)
            start, rest = start + part, rest - part
    return out


class Encoder:
    """Ids of texts as by ``vocabulary`` (special tokens in a text included); ``ranks``, the same vocabulary, gives the same ids in a
    fraction of the time, but gives up on some hundred thousand white space characters in a row, for which the former is used."""

    def __init__(self, s: Settings):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(s.ranks), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(s.special))
        self.settings, self.encode = s, own.encode_to_numpy

    def part(self, text: str) -> np.ndarray:
        try:
            return self.encode(text, allowed_special="all")
        except ValueError:
            import public_tokenizers
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(public_tokenizers.path(self.settings.vocabulary))
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def document(self, text: str | None) -> np.ndarray:
        parts = [self.part(part) for part in slices(text or "", self.settings.slice)]
        return np.concatenate([*parts, np.array([self.settings.end], np.uint32)])


def _pack(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(s)
        task = TaskContext.get().partitionId() << 33
        made = 0
        names = None
        keys: list[pa.Array] = []  # of the documents held, one entry each
        tails: list[np.ndarray] = []  # their tokens that fill no sequence
        counts: list[int] = []  # all their tokens
        full: list[tuple[int, int, np.ndarray]] = []  # document, start and tokens of whole sequences
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, keys, tails, counts, full, waiting
            rows = [(doc, start, ids, made + i, 0, s.length) for i, (doc, start, ids) in enumerate(full)]
            made += len(full)
            sizes = np.array([len(x) for x in tails], np.int64)
            capacities = room(int(sizes.sum()), s.length)
            for doc, start, n, sequence, offset in assign(sizes, capacities, s.hidden):
                before = counts[doc] - len(tails[doc])
                rows.append((doc, before + start, tails[doc][start : start + n], made + sequence, offset, int(capacities[sequence])))
            made += len(capacities)
            docs = np.array([r[0] for r in rows], np.int64)
            lengths = np.array([len(r[2]) for r in rows], np.int64)
            held = pa.Table.from_batches(keys).take(pa.array(docs)).combine_chunks() if names else None
            columns = [held.column(i).combine_chunks() for i in range(len(names))] if names else []
            columns += [
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array(lengths),
                pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()),
                pa.array(np.array(counts, np.int64)[docs]),
                pa.array(task + np.array([r[3] for r in rows], np.int64)),
                pa.array([r[4] for r in rows], pa.int64()),
                pa.array(cost_of(lengths.astype(np.float64), s.hidden)),
                pa.array([r[5] for r in rows], pa.int32()),
            ]
            keys, tails, counts, full, waiting = [], [], [], [], 0
            own = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost", "capacity"]
            return pa.RecordBatch.from_arrays(columns, names=[*(names or []), *own])

        for batch in batches:
            names = batch.schema.names[:-1]
            for row, text in enumerate(batch.column(batch.num_columns - 1)):
                ids = encoder.document(text.as_py())
                cut = len(ids) - len(ids) % s.length
                full += [(len(counts), at, ids[at : at + s.length]) for at in range(0, cut, s.length)]
                tails.append(ids[cut:])
                counts.append(len(ids))
                keys.append(batch.slice(row, 1).select(names))
                waiting += len(ids)
                if waiting >= s.block:
                    yield flush()
        if counts:
            yield flush()

    return run


def pack(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``keys`` and, per piece: start in its document, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset there, cost,
    capacity of the sequence (its room, all of it filled)."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(text_col).cast("string").alias("text"))
    schema = "".join(f"{name} {kind}, " for name, kind in rows.dtypes[:-1]) + PIECES
    packed = rows.mapInArrow(_pack(settings), schema)
    return packed.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keys)})


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: n_pieces, n_tokens, cost, and its pieces' ids side by side."""
    piece = F.struct("offset", "ids")
    grouped = packed.groupBy("sequence_id").agg(
        F.count("*").alias("n_pieces"),
        F.sum("length").alias("n_tokens"),
        F.sum("cost").alias("cost"),
        F.sort_array(F.collect_list(piece)).alias("parts"),  # a sequence has at most ``length`` pieces
    )
    ids = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", "n_pieces", "n_tokens", "cost", ids.alias("ids"))
