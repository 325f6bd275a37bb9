"""n-gram match statistics of (hypothesis, reference) pairs.

Three kinds: "words" (13a tokens, orders 1-4, for BLEU), "chars" (white space removed, orders 1-6,
for chrF) and "peeled" (words with a punctuation mark split off, orders 1-2, for chrF++).
Statistics are an ``ARRAY<BIGINT>``: hyp n-grams for orders 1..N, then ref n-grams, then clipped
matches. Two ways lead there:

* :func:`pair_statistics`: a column expression computed where the row lies. Nothing is shuffled
  and no row is multiplied, so a repeated or very long text costs only its own length. This is
  what the scorers use.
* :func:`exploded_statistics`: the relational form (explode, group by gram, group by pair) with
  one exchange; the checked form, and the one that needs no Python worker. Every character becomes a
  row for each side and order, so it is for keys that several rows share.

:func:`long_statistics` gives the relational form's rows by the first way for keys that are there once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrip.functions import kernel, text
from echotrip.session import spread, stage

ORDERS = {"words": 4, "chars": 6, "peeled": 2}
# Characters of a large and a small piece; the small size divides the large one.
PIECES = (4096, 64)


def pair_statistics(hyp: Column, ref: Column, kinds: list[str]) -> Column:
    """Struct with one statistics array per kind. NULL texts count as empty.

    Texts cross to Python once, as Arrow batches, for all kinds together; there they are tokenised word by word, where
    every word is cut once a task, and counted batch-wise.
    """
    return sides_statistics([(hyp, ref, kinds)])["s0"]


def sides_statistics(sides: list[tuple[Column, Column, list[str]]]) -> Column:
    """``pair_statistics`` of several pairs of a row, as fields s0, s1, ...: the texts cross together, and a word that
    several sides have is looked up in one list."""
    texts = [F.coalesce(t.cast("string"), F.lit("")) for hyp, ref, _ in sides for t in (hyp, ref)]
    kinds = [kinds for _, _, kinds in sides]
    cut = [kind for kind in kernel.CUTS if any(kind in wanted for wanted in kinds)]
    known: dict[str, kernel.Words] = {}  # filled anew in every task

    def packed(rows: dict[str, np.ndarray]) -> pa.Array:
        arrays = []
        for found in rows.values():
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
            arrays.append(pa.ListArray.from_arrays(ends, pa.array(found.ravel())))
        return pa.StructArray.from_arrays(arrays, names=[*rows])

    fields = ["struct<" + ", ".join(f"{kind}: array<bigint>" for kind in wanted) + ">" for wanted in kinds]

    @F.arrow_udf("struct<" + ", ".join(f"s{i}: {field}" for i, field in enumerate(fields)) + ">")
    def statistics(*columns: pa.Array) -> pa.Array:
        if not known:
            known.update(kernel.known_words(cut))
        each = [
            packed(kernel.batch_statistics([*columns[2 * i : 2 * i + 2]], {kind: ORDERS[kind] for kind in wanted}, known))
            for i, wanted in enumerate(kinds)
        ]
        return pa.StructArray.from_arrays(each, names=[f"s{i}" for i in range(len(each))])

    return statistics(*texts)


def _windows(symbols: Column, orders: int) -> Column:
    """Windows of up to ``orders`` symbols starting at each position, as arrays."""
    return F.transform(
        F.sequence(F.lit(1), F.size(symbols)), lambda i: F.slice(symbols, i, F.lit(orders))
    )


def _char_windows(t: Column, orders: int) -> Column:
    """Windows of up to ``orders`` characters starting at each position of a text that has any.

    Substring walks from the start of its text each time, so texts are cut into large pieces, these into small ones, and windows
    from the small ones: the work grows with the text, whatever its length.
    """

    def cut(s: Column, starts: Column, size: int, then) -> Column:
        """Results of pieces of ``size`` starts each (and the characters that their last windows reach)."""
        steps = F.sequence(F.lit(0), starts - 1, F.lit(size))
        return F.flatten(F.transform(steps, lambda i: then(F.substr(s, i + 1, F.lit(size + orders - 1)), F.least(F.lit(size), starts - i))))

    def windows(s: Column, starts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), starts), lambda i: F.substr(s, i, F.lit(orders)))

    large, small = PIECES
    return cut(t, F.length(t), large, lambda s, starts: cut(s, starts, small, windows))


def exploded_statistics(
    pairs: DataFrame, keys: list[str], kind: str, hyp: str = "hyp", ref: str = "ref"
) -> DataFrame:
    """Long form ``(*keys, n, hyp_ngrams, ref_ngrams, matches)``, one row per key and order.

    ``keys`` must identify a pair. The short pair rows are exchanged once on ``keys``; both
    groupings then stay inside the partition. A pair's n-grams are told apart by 64-bit hashes, which group faster than strings. Orders
    without any n-gram on either side give zeros.
    """
    orders = ORDERS[kind]
    sides = spread(pairs.select(*keys, hyp, ref), *keys).select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("is_hyp"), F.coalesce(hyp, F.lit("")).alias("t")),
                F.struct(F.lit(0).alias("is_hyp"), F.coalesce(ref, F.lit("")).alias("t")),
            )
        ).alias("s"),
    )
    if kind == "chars":
        squeezed = sides.select(*keys, "s.is_hyp", text.squeeze(F.col("s.t")).alias("t"))
        # An empty text has one empty window.
        windows = F.when(F.length("t") > 0, _char_windows(F.col("t"), orders)).otherwise(F.array(F.lit("")))
        starts = squeezed.select(*keys, "is_hyp", F.explode(windows).alias("w"))
        size, gram = F.length("w"), lambda n: F.xxhash64(F.left("w", F.lit(n)))
    else:
        tokens = text.tokenize_13a if kind == "words" else text.peel_punctuation
        starts = sides.select(*keys, "s.is_hyp", tokens(F.col("s.t")).alias("tokens")).select(
            *keys,
            "is_hyp",
            F.explode(
                F.when(F.size("tokens") > 0, _windows(F.col("tokens"), orders)).otherwise(
                    F.array(F.array().cast("array<string>"))
                )
            ).alias("w"),
        )
        size = F.size("w")
        gram = lambda n: F.xxhash64(F.slice("w", F.lit(1), F.lit(n)))
    # Windows at the end of a text are short: the missing orders keep a NULL gram, which holds
    # the (key, order) row but counts nothing.
    grams = starts.select(
        *keys,
        "is_hyp",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("n"), F.when(size >= n, gram(n)).alias("gram"))
                    for n in range(1, orders + 1)
                ]
            )
        ).alias("g"),
    ).select(*keys, "is_hyp", "g.n", "g.gram")
    counted = grams.groupBy(*keys, "n", "gram").agg(
        F.sum("is_hyp").alias("h"), F.sum(1 - F.col("is_hyp")).alias("r")
    )
    real = F.col("gram").isNotNull()

    def total(value: Column, name: str) -> Column:
        return F.sum(F.when(real, value).otherwise(0)).alias(name)

    return counted.groupBy(*keys, "n").agg(
        total(F.col("h"), "hyp_ngrams"),
        total(F.col("r"), "ref_ngrams"),
        total(F.least("h", "r"), "matches"),
    )


def gather_statistics(long: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Long form back to one statistics array per key (same partitioning, no exchange)."""
    cells = [
        F.sum(F.when(F.col("n") == n, F.col(c)).otherwise(0))
        for c in ("hyp_ngrams", "ref_ngrams", "matches")
        for n in range(1, ORDERS[kind] + 1)
    ]
    return long.groupBy(*keys).agg(F.array(*cells).alias(kind))


def single_and_shared(pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys no other row has, and the rest; null keys are one group. One exchange, on the keys; staged, as both are read."""
    counted = spread(pairs, *keys).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    counted = stage(counted, "keyed")
    return tuple(counted.where(found).drop("_rows") for found in (F.col("_rows") == 1, F.col("_rows") > 1))


def long_statistics(pairs: DataFrame, keys: list[str], kind: str, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """The rows of ``exploded_statistics``. A key that is there once is counted where its row lies; only rows that share a
    key, whose n-grams count together, are exploded."""
    single, shared = single_and_shared(pairs.select(*keys, hyp, ref), keys)
    orders = ORDERS[kind]
    counted = single.select(*keys, pair_statistics(F.col(hyp), F.col(ref), [kind])[kind].alias("_stats"))
    cells = [
        F.struct(F.lit(n + 1).alias("n"), *[F.get("_stats", F.lit(n + k * orders)).alias(c) for k, c in enumerate(("hyp_ngrams", "ref_ngrams", "matches"))])
        for n in range(orders)
    ]
    return counted.select(*keys, F.inline(F.array(*cells))).unionByName(exploded_statistics(shared, keys, kind, hyp, ref))
