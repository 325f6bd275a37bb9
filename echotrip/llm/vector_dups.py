"""Near duplicates among vectors, by rotated binary codes with correction factors.

Vectors are scaled to length one, rotated at random into ``bits`` dimensions and reduced to signs. With its stored factor
f = <code, vector>, a code gives an unbiased estimate <code, query> / f of an inner product, whose error is within
``sigmas`` * sqrt((1 - f^2) / f^2 / (bits - 1)). Queries are cut to 4 bits a dimension with random rounding, so an estimate is
four popcounts. Codes, factors and queries are made once and stored. Pairs whose upper bound stays below the threshold are dropped; all
others are computed exactly in double precision.

Pairs to look at come from ``tables`` groupings by ``depth`` sign bits of other random directions. Depth follows the number of
vectors, so groups stay small, and the number of tables follows from depth: a pair at the threshold meets in one of them with chance
``recall``, more similar pairs more surely. A group that is larger than ``block`` (copies) is cut into blocks, and every two blocks meet
in a task of their own. Groups meet by their codes first; only members with a partner left meet again, with their vectors. A pair is counted only in the first table where it meets; tasks give sums per vector and a spanning set of
links, never pairs. Equal vectors, told by 128 bits of hashes, are folded to one that stands for all before anything meets, so
a crowd of copies costs one vector.

Defined results: a vector that is null, zero, or holds null or non-finite components links with nothing, and so do vectors of
different lengths; components of any finite size count (vectors are scaled by their largest one first); equal vectors are linked;
of repeated rows of one id one counts (the least); rows with a null id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrip.llm.dictionaries import is_finite
from echotrip.llm.graph import components
from echotrip.session import stage


GROUP = ["table", "width", "key", "lo", "hi"]  # rows that meet


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.9
    bits: int = 128  # at least the vectors' length; raised to a multiple of 64
    sigmas: float = 4.0
    group: int = 48  # vectors of a table's group, on average
    recall: float = 0.998
    block: int = 1024
    pairs: int = 1 << 18  # looked at together in a task
    seed: int = 3


def plan_tables(n: int, s: Settings) -> tuple[int, int]:
    """Depth and number of tables for ``n`` vectors."""
    depth = max(1, min(31, round(math.log2(max(n, 2) / s.group))))
    meet = (1 - math.acos(s.threshold) / math.pi) ** depth
    return depth, max(1, math.ceil(math.log(1 - s.recall) / math.log(1 - meet)))


def rotation(width: int, bits: int, seed: int) -> np.ndarray:
    """``bits`` rows whose columns are orthonormal."""
    draw = np.random.default_rng([seed, width]).standard_normal((bits, bits))
    return np.linalg.qr(draw)[0][:, :width]


def pack(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, axis=1, bitorder="little").view("<u8")


def encode(unit: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their sign codes (64 bits a word) and factors <code, vector>."""
    turned = unit @ rotation(unit.shape[1], bits, seed).T
    return turned, pack(turned > 0), np.abs(turned).sum(axis=1) / math.sqrt(bits)


def planes(turned: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries in 4 bits: four bit planes, step and lowest value of each; rounding is random, so its error has mean 0."""
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / 15 + 1e-30
    noise = np.random.default_rng(seed).random(turned.shape)
    level = np.minimum(np.floor((turned - low[:, None]) / step[:, None] + noise), 15).astype(np.uint8)
    return np.stack([pack((level >> j) & 1 == 1) for j in range(4)], axis=1), step, low


def totals(code: np.ndarray, plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What an estimate needs of each side alone: set bits of the code, sum of the query's levels."""
    level = sum(np.bitwise_count(plane[:, j]).sum(axis=1, dtype=np.int64) << j for j in range(4))
    return np.bitwise_count(code).sum(axis=1, dtype=np.int64), level


def estimates(code, factor, plane, step, low, bits: int, ones=None, level=None) -> np.ndarray:
    """Unbiased estimate of the inner products of coded vectors with queries, pair by pair; ``ones`` and ``level`` are their ``totals``."""
    if ones is None:
        ones, level = totals(code, plane)
    inside = np.zeros(len(code), np.int64)
    for word in range(code.shape[1]):
        own = code[:, word]
        for j in range(4):
            inside += np.bitwise_count(own & plane[:, j, word]).astype(np.int64) << j
    dot = step * (2 * inside - level) + low * (2 * ones - bits)
    return dot / math.sqrt(bits) / factor


def slack(factor: np.ndarray, step: np.ndarray, bits: int, sigmas: float) -> np.ndarray:
    """How far an estimate may lie from the inner product: the code's error and that of the 4-bit query."""
    code = np.sqrt(np.maximum(1 - factor**2, 0) / (bits - 1)) / factor
    return sigmas * (code + step / (2 * factor))


def _rows(column: pa.Array) -> list[np.ndarray]:
    """Vectors; those that are null or hold a null become empty."""
    return [x.values.to_numpy() if x.is_valid and not x.values.null_count else np.zeros(0) for x in column]


def _unit(table: np.ndarray) -> np.ndarray:
    """Vectors of length one; squares of the components themselves may pass a double, or vanish, so the largest one is divided out first."""
    table = table / np.abs(table).max(axis=1, keepdims=True)
    return table / np.sqrt((table * table).sum(axis=1, keepdims=True))


def _layout(width: int, depth: int, tables: int, s: Settings) -> tuple[int, np.dtype]:
    """Bits of a code, and what is stored of a vector: code, factor, query and the sign bits of its groups."""
    bits = 64 * math.ceil(max(s.bits, width) / 64)
    words = bits // 64
    fields = [("factor", "<f8"), ("step", "<f8"), ("low", "<f8"), ("code", "<u8", (words,)), ("plane", "<u8", (4, words))]
    return bits, np.dtype([*fields, ("signs", "u1", (math.ceil(tables * depth / 8),))])


def _coded(depth: int, tables: int, s: Settings):
    """Vectors to stored codes and the keys of their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column("vector"))
            widths = np.array([len(x) for x in rows], np.int64)
            for width in np.unique(widths[widths > 0]).tolist():
                at = np.flatnonzero(widths == width)
                table = np.stack([rows[i] for i in at])
                largest = np.abs(table).max(axis=1)
                fine = np.isfinite(largest) & (largest > 0)
                at = at[fine]
                if not len(at):
                    continue
                unit = _unit(table[fine])
                draw = np.random.default_rng([s.seed + 1, width]).standard_normal((tables * depth, width))
                signs = unit @ draw.T > 0
                bits, layout = _layout(width, depth, tables, s)
                turned, code, factor = encode(unit, bits, s.seed)
                body = np.zeros(len(at), layout)
                body["code"], body["factor"] = code, factor
                body["plane"], body["step"], body["low"] = planes(turned, s.seed)
                body["signs"] = np.packbits(signs, axis=1, bitorder="little")
                keys = _group_keys(body["signs"], depth, tables)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(at)),
                        pa.array(np.full(len(at), width, np.int32)),
                        pa.array([x.tobytes() for x in body], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(keys.ravel())),
                    ],
                    names=["id", "width", "body", "keys"],
                )

    return run


def _group_keys(signs: np.ndarray, depth: int, tables: int) -> np.ndarray:
    flags = np.unpackbits(signs, axis=1, count=tables * depth, bitorder="little").reshape(len(signs), tables, depth)
    return (flags * (1 << np.arange(depth))).sum(axis=2).astype(np.int32)


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number reachable over the links (a, b), within one task's group."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def _pairs(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, part: np.ndarray, limit: int):
    """Row numbers of the pairs within groups, about ``limit`` at a time; a group is at most two blocks."""
    left, right, size = [], [], 0
    for x, y in zip(starts.tolist(), ends.tolist()):
        if lo[x] == hi[x]:
            i, j = np.triu_indices(y - x, 1)
        else:
            low, high = np.flatnonzero(part[x:y] == lo[x]), np.flatnonzero(part[x:y] == hi[x])
            i, j = np.repeat(low, len(high)), np.tile(high, len(low))
        left.append(i + x)
        right.append(j + x)
        size += len(i)
        if size >= limit:
            yield np.concatenate(left), np.concatenate(right)
            left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a partition that is sorted by group, some at a time, with their edges."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        key = np.stack([held[c].to_numpy() for c in GROUP], axis=1)
        if not len(key):
            continue
        # All but the last group are whole.
        changes = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if len(changes):
            yield held.slice(0, int(changes[-1])), np.concatenate([[0], changes])
            held = held.slice(int(changes[-1]))
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def _near_pairs(rows: pa.Table, edges: np.ndarray, depth: int, tables: int, s: Settings):
    """Row numbers of pairs that meet here first and whose upper bound reaches the threshold, by width: width, rows of it, pairs."""
    widths, table = rows["width"].to_numpy(), rows["table"].to_numpy()
    lo, hi, part = (rows[c].to_numpy() for c in ("lo", "hi", "part"))
    for width in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == width)
        bits, layout = _layout(width, depth, tables, s)
        body = np.frombuffer(b"".join(rows["body"].take(pa.array(mine)).to_pylist()), layout)
        # Fields are strided in the body; pairs pick from arrays of their own.
        code, factor, plane, step, low = (np.ascontiguousarray(body[c]) for c in ("code", "factor", "plane", "step", "low"))
        ones, level = totals(code, plane)
        own = _group_keys(body["signs"], depth, tables)
        place = np.zeros(len(widths), np.int64)
        place[mine] = np.arange(len(mine))
        same = widths[edges[:-1]] == width
        for i, j in _pairs(edges[:-1][same], edges[1:][same], lo, hi, part, s.pairs):
            p, q = place[i], place[j]
            top = estimates(code[p], factor[p], plane[q], step[q], low[q], bits, ones[p], level[q])
            near = top + slack(factor[p], step[q], bits, s.sigmas) >= s.threshold
            i, j, p, q = i[near], j[near], p[near], q[near]
            first = (own[p] == own[q]).argmax(axis=1) == table[i]
            yield width, mine, i[first], j[first], p[first], q[first]


def _sifted(depth: int, tables: int, s: Settings):
    """Members of groups that have a partner left by their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in _groups(batches):
            left = np.zeros(len(rows), bool)
            for _, _, i, j, _, _ in _near_pairs(rows, edges, depth, tables, s):
                left[i] = left[j] = True
            yield from rows.filter(pa.array(left)).to_batches()

    return run


def _linked(depth: int, tables: int, s: Settings):
    """Rows with their vectors: counts of links per vector, and links to the group's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in _groups(batches):
            ids, weights = rows["id"].to_numpy(), rows["weight"].to_numpy()
            counts, left, right, held, unit = np.zeros(len(ids), np.int64), [], [], 0, None
            for width, mine, i, j, p, q in _near_pairs(rows, edges, depth, tables, s):
                if width != held:
                    held = width
                    unit = _unit(rows["vector"].take(pa.array(mine)).combine_chunks().flatten().to_numpy().reshape(len(mine), width))
                linked = np.einsum("ij,ij->i", unit[p], unit[q]) >= s.threshold
                i, j = i[linked], j[linked]
                np.add.at(counts, i, weights[j])
                np.add.at(counts, j, weights[i])
                left.append(i)
                right.append(j)
            if left:
                root = _local_roots(len(ids), np.concatenate(left), np.concatenate(right))
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(counts[some]), pa.array(ids[root[some]])], names=["id", "n", "root"]
                )

    return run


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()
) -> DataFrame:
    """One row per vector: id, n_links (other vectors at the threshold or above), component_id (smallest id that links reach), kept."""
    s = settings
    named = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null")
    again = stage(named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    once = named.join(again, "id", "left_anti").union(named.join(again, "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector")))
    found = is_finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    hashes = [F.xxhash64(F.lit(k), "vector").alias(f"h{k}") for k in (1, 2)]
    every = stage(once.select("id", "vector", F.coalesce(found, F.lit(False)).alias("fine"), *hashes), "vectors")
    groups = every.where("fine").groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("id").alias("first"))
    copies = stage(groups.where("weight > 1"), "copies")
    folded = every.where("fine").join(copies, ["h1", "h2"], "left")
    folded = stage(folded.select("id", "vector", F.coalesce("first", "id").alias("first"), F.coalesce("weight", F.lit(1)).alias("weight")), "folded")
    vectors = folded.where("id = first").select("id", "weight", "vector")
    depth, tables = plan_tables(vectors.count(), s)
    codes = vectors.select("id", "vector").mapInArrow(_coded(depth, tables, s), "id bigint, width int, body binary, keys array<int>")
    codes = stage(codes, "codes")
    group = ["table", "width", "key"]
    keyed = codes.select("id", "width", "body", F.posexplode("keys").alias("table", "key"))
    large = keyed.groupBy(*group).agg(F.count("*").alias("size")).where(F.col("size") > s.block)
    large = stage(large.select(*group, F.ceil(F.col("size") / s.block).cast("int").alias("blocks")), "large")
    cut = keyed.join(large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select(*group, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "body")

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition(*[F.col(c) for c in GROUP]).sortWithinPartitions(*GROUP)

    left = stage(together(cut).mapInArrow(_sifted(depth, tables, s), cut.schema), "left")
    exact = left.join(vectors, "id").select(*left.columns, "weight", "vector")
    found = stage(together(exact).mapInArrow(_linked(depth, tables, s), "id bigint, n bigint, root bigint"), "found")
    linked = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    label = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    joined = every.select("id").join(folded.select("id", "first", "weight"), "id", "left")
    joined = joined.join(linked.withColumnRenamed("id", "first"), "first", "left").join(label.withColumnRenamed("id", "first"), "first", "left")
    joined = joined.withColumn("component_id", F.coalesce("component_id", "first", "id"))
    return joined.select(
        F.col("id").alias(id_col),
        (F.coalesce("n_links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("bigint").alias("n_links"),
        "component_id",
        (F.col("component_id") == F.col("id")).alias("kept"),
    )
