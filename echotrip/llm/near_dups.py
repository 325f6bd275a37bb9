"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Texts become sets of word shingles (64-bit fingerprints). Texts with equal sets are folded into one
before anything else, so thousands of copies cost one small row each. A set's MinHash signature is cut
into bands; sets that agree in a band are candidates. A band's members are first compared with one of
them (the head), which joins groups of near copies in linear work. What then still stands in different components of one band
is paired by its rarest shingles, which loses nothing and does not pair all texts that share a passage. A pair is compared a batch of signature entries at a time and given up as soon as the posterior
chance that its similarity reaches the threshold falls below ``miss``; survivors are verified on their full sets.

Defined results: null and empty texts have an empty set and link with nothing; a text of fewer words
than a shingle is one shingle; repeated rows of one id count once (the least text, nulls last); an empty table gives
an empty result; columns other than the named two are ignored. Missed links: bands of 4 out of 128 entries miss a pair
of similarity 0.75 with probability 5e-6, and pruning with probability ``miss``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotrip.llm import arrays
from echotrip.llm.graph import components
from echotrip.session import stage


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 75  # links have 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 4
    batch: int = 16  # signature entries compared between two looks at the posterior
    miss: float = 1e-6
    star_rounds: int = 2
    seed: int = 7

    @property
    def entries(self) -> int:
        return self.bands * self.rows


CARD = "id bigint, n_shingles bigint, digest_a bigint, digest_b bigint, signature binary, bands array<bigint>"
SETS = "id bigint, shingles array<bigint>"


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle fingerprints of every text, in order."""
    for _, _, data, offsets in arrays.pieces(column):
        data = arrays.LOWER[data]
        begin, end, owner = arrays.words_of(data, offsets)
        hashes = arrays.Rolling(data).of(begin, end) if len(begin) else np.zeros(0, np.uint64)
        runs = arrays.sequence_hash(hashes, words)
        counts = np.bincount(owner, minlength=len(offsets) - 1)
        stop = 0
        for n in counts.tolist():
            start, stop = stop, stop + n
            if n >= words:
                yield np.unique(runs[start : stop - words + 1])
            else:
                yield arrays.sequence_hash(hashes[start:stop], n) if n else np.zeros(0, np.uint64)


def _family(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(s.seed).integers(0, 1 << 32, (2, s.entries), dtype=np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest value of each hash function over the set; long sets go through in slices."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(family[0]), np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(short), 512):
        table = short[lo : lo + 512, None] * family[0]
        table += family[1]
        np.minimum(least, table.min(axis=0), out=least)
    return arrays.mix(least.astype(np.uint64))


def _cards(id_col: str, text_col: str, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _family(s)
        for batch in batches:
            ids, sizes, sums, xors, sigs, bands = [], [], [], [], [], []
            for shingles in shingle_sets(batch.column(text_col), s.words):
                sizes.append(len(shingles))
                sums.append(int(arrays.mix(shingles).sum().view(np.int64)) if len(shingles) else 0)
                xors.append(int(np.bitwise_xor.reduce(shingles).view(np.int64)) if len(shingles) else 0)
                if len(shingles):
                    least = signature(shingles, family)
                    sigs.append((least >> np.uint64(48)).astype("<u2").tobytes())
                    keys = np.arange(1, s.bands + 1, dtype=np.uint64)
                    for column in least.reshape(s.bands, s.rows).T:
                        keys = arrays.mix(keys * np.uint64(0x9FB21C651E98DF25) + column)
                    bands.append(keys.view(np.int64))
                else:
                    sigs.append(b"")
                    bands.append(np.zeros(0, np.int64))
            ids = batch.column(id_col)
            lengths = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(xors, pa.int64()),
                    pa.array(sigs, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat, pa.int64())),
                ],
                names=["id", "n_shingles", "digest_a", "digest_b", "signature", "bands"],
            )

    return run


def _sets(id_col: str, text_col: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.view(np.int64) for x in shingle_sets(batch.column(text_col), words)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), column], names=["id", "shingles"])

    return run


def fewest_matches(s: Settings) -> list[int]:
    """For each number of compared entries at a batch's end, the least number of equal ones that is not given up.

    With a flat prior, after m equal entries of n the similarity has a Beta(m + 1, n - m + 1) posterior;
    its tail above t is the chance that n + 1 fair trials at t succeed at most m times.
    """
    t, least = s.percent / 100, []
    for n in range(s.batch, s.entries + 1, s.batch):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= s.miss:
                least.append(m)
                break
    return least


def _plausible(s: Settings):
    least = fewest_matches(s)

    def run(left: pa.Array, right: pa.Array) -> np.ndarray:
        a = np.frombuffer(b"".join(left.to_pylist()), "<u2").reshape(len(left), s.entries)
        b = np.frombuffer(b"".join(right.to_pylist()), "<u2").reshape(len(left), s.entries)
        alive, equal = np.arange(len(left)), np.zeros(len(left), np.int64)
        for k, needed in enumerate(least):
            span = slice(k * s.batch, (k + 1) * s.batch)
            equal = equal + (a[alive, span] == b[alive, span]).sum(axis=1)
            passed = equal >= needed
            alive, equal = alive[passed], equal[passed]
        out = np.zeros(len(left), bool)
        out[alive] = True
        return out

    return run


def _prune(s: Settings):
    test = _plausible(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(test(batch.column("sig_a"), batch.column("sig_b")))
            yield batch.filter(keep).select(["a", "b", "n_a", "n_b"])

    return run


def verify(pairs: DataFrame, cards: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold, after pruning by signature batches."""
    side = lambda x: cards.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"sig_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.where(100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b"))
    likely = stage(sized.mapInArrow(_prune(s), "a bigint, b bigint, n_a bigint, n_b bigint"), "likely")
    full = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = likely.join(full("a"), "a").join(full("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= s.percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _open(rows: DataFrame, label: DataFrame | None, key: str) -> DataFrame:
    """Rows (id, ``key``, ...) of keys that still hold more than one component, with it as ``part``."""
    if label is None:
        return rows.withColumn("part", F.col("id"))
    named = rows.join(label, "id", "left").withColumn("part", F.coalesce("component_id", "id")).drop("component_id")
    mixed = named.groupBy(key).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    return stage(named.join(stage(mixed.select(key), "mixed"), key, "left_semi"), "open")


def _star_pairs(parts: DataFrame, key: str, rank: str, turn: int) -> DataFrame:
    """Every member of a key with the key's head: the one of least ``rank`` first, another in odd turns."""
    order = F.struct(F.expr(rank), "id") if turn % 2 == 0 else F.struct(F.xxhash64(F.lit(turn), "id"), "id")
    head = F.min(F.struct(order.alias("rank"), F.col("id").alias("head"), F.col("part").alias("head_part")))
    heads = stage(parts.groupBy(key).agg(head.alias("h")).select(key, "h.head", "h.head_part"), "heads")
    pairs = parts.join(heads, key).where("part <> head_part")
    return pairs.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()


def _prefix(ids: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The rarest shingles of every text: id, n, shingle, often (texts that hold it), place (from 1), rest (shingles from there on).

    With shingles ordered from rare to common, two sets that reach the threshold share one of the first
    n - ceil(threshold * n) + 1 of either.
    """
    rows = sets.join(ids, "id", "left_semi").select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    order = Window.partitionBy("id").orderBy("often", "shingle")
    ranked = rows.join(often, "shingle").withColumn("place", F.row_number().over(order))
    prefix = ranked.where(F.expr(f"place <= n - (({s.percent} * n + 99) div 100) + 1 and often > 1"))
    return prefix.select("id", "n", "shingle", "often", "place", F.expr("n - place + 1").alias("rest"))


def _prefix_pairs(parts: DataFrame, s: Settings) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles.

    Two texts share at most what follows, in either, from the first shingle they share. That bounds their similarity, and
    a text that cannot even reach the one with the fewest rarer shingles is left out before anything is paired. Of shingles that
    the same texts share, the first in the order of places stands for all. Nothing is lost, and what thousands share makes few pairs.
    """
    sign = F.sum(F.xxhash64("id").cast("decimal(38,0)"))
    held = [sign.alias("sign"), F.count("*").alias("size"), (F.min("place") - 1).alias("fewest"), F.min("often").alias("often")]
    mixed = parts.groupBy("shingle").agg(*held)
    first = F.min(F.struct("often", "shingle", "fewest")).alias("first")
    mixed = mixed.groupBy("sign", "size").agg(first).select("first.shingle", "first.fewest")
    left = parts.join(mixed, "shingle").where(f"100 * rest >= {s.percent} * (n + fewest)")
    left = stage(left.select("id", "part", "n", "rest", "shingle"), "left")
    right = left.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("id", "part", "n", "rest")])
    bound = f"100 * least(rest, rest_b) >= {s.percent} * (n + n_b - least(rest, rest_b))"
    pairs = left.join(right, "shingle").where(f"id < id_b and part <> part_b and {bound}")
    return pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


def one_per_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per id: the least text, nulls last, then the least of the other columns, which must have an order.

    Rows without an id go. Only ids that occur twice are grouped; their minima are taken before rows move.
    """
    rows = docs.where(F.col(id_col).isNotNull())
    twice = stage(rows.groupBy(id_col).agg(F.count("*").alias("rows")).where("rows > 1").select(id_col), "twice")
    if twice.isEmpty():
        return rows
    rest = [F.col(c) for c in docs.columns if c not in (id_col, text_col)]
    order = F.struct(F.col(text_col).isNull().alias("__last"), F.col(text_col), *rest)
    folded = rows.join(twice, id_col, "left_semi").groupBy(id_col).agg(F.min(order).alias("__row"))
    folded = folded.select(*[F.col(id_col) if c == id_col else F.col("__row")[c].alias(c) for c in docs.columns])
    return rows.join(twice, id_col, "left_anti").select(*docs.columns).union(stage(folded, "folded"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """One row per id: id, n_shingles, component_id (smallest id that links reach), kept.

    Bands of a group of copies hold many members; they only meet map-side minima and joins on the band,
    which adaptive execution splits.
    """
    s = settings
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = one_per_id(texts, "id", "text")
    made = stage(texts.mapInArrow(_cards("id", "text", s), CARD), "cards")
    light = made.select("id", "n_shingles", "digest_a", "digest_b")
    digest = ["n_shingles", "digest_a", "digest_b"]
    # Aggregated sides are staged before they are joined: adaptive execution can then split a common key's rows.
    least = stage(light.where("n_shingles > 0").groupBy(*digest).agg(F.min("id").alias("rep")), "least")
    members = light.join(least, digest, "left").select("id", "n_shingles", F.coalesce("rep", "id").alias("rep"))
    members = stage(members, "members")
    reps = members.where("id = rep and n_shingles > 0").select("id").distinct()
    single = made.join(reps, "id", "left_semi")
    keyed = single.select("id", "n_shingles", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    shared = stage(shared.select("band"), "shared")
    banded = stage(keyed.join(shared, "band", "left_semi"), "banded")
    wanted = banded.select("id").distinct()
    cards = stage(made.select("id", "n_shingles", "signature").join(wanted, "id", "left_semi"), "wanted")
    sets = stage(texts.join(wanted, "id", "left_semi").mapInArrow(_sets("id", "text", s.words), SETS), "sets")

    links, label, tried, prefix = None, None, None, None
    for turn in range(2 * s.star_rounds + 1):
        if turn < s.star_rounds:
            pairs = _star_pairs(_open(banded, label, "band"), "band", "n_shingles", turn)
        else:
            if prefix is None:
                prefix = stage(_prefix(_open(banded, label, "band").select("id").distinct(), sets, s), "prefix")
            parts = _open(prefix, label, "shingle")
            last = turn == 2 * s.star_rounds
            pairs = _prefix_pairs(parts, s) if last else _star_pairs(parts, "shingle", "place", turn)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        found = stage(verify(pairs, cards, sets, s), "links")
        links = found if links is None else links.union(found)
        label = components(links)

    if label is None:
        named = members.withColumn("component_id", F.col("rep"))
    else:
        label = label.withColumnRenamed("id", "rep")
        named = members.join(label, "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    return named.select(
        F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
