"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer every context limit.

Texts are encoded where they lie; what is shuffled is one row per length and task. Running sums over the lengths go in
two levels (blocks of lengths, then lengths of a block), so no task takes the whole histogram once it is long.

Defined results: null and empty texts have 0 tokens; repeated rows each count; an empty table gives an empty histogram,
totals of 0 and null quantiles.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotrip.session import stage

# Fixed value: the split pattern that belongs to the public 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The same vocabulary for texts with some hundred thousand white space characters in a row, on which the split by pattern gives up.
SLOW_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK = 1024


def encoding(path: str, pattern: str = PATTERN):
    """Built once per task, in a fraction of a second."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counter(path: str, pattern: str, slow_path: str):
    """Number of tokens of a text, special tokens in it read as any other text."""
    own = encoding(path, pattern)

    def count(text: str) -> int:
        try:
            return len(own.encode_to_numpy(text, disallowed_special=()))
        except ValueError:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(slow_path)
            whole.encode_special_tokens = True
            return len(whole.encode(text, add_special_tokens=False).ids)

    return count


def _count(path: str, pattern: str, slow_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern, slow_path)
        for batch in batches:
            counts = [count(text) if text else 0 for text in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def token_lengths(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = (), path: str = VOCABULARY, pattern: str = PATTERN, slow_path: str = SLOW_VOCABULARY) -> DataFrame:
    """``keys`` and n_tokens of every row."""
    rows = docs.select(*keys, F.col(text_col).cast("string").alias("text"))
    schema = "".join(f"`{c}` {kind}, " for c, kind in rows.dtypes[:-1]) + "n_tokens bigint"
    return rows.mapInArrow(_count(path, pattern, slow_path), schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs and what follows from suffix sums over longer lengths.

    docs_at_most and docs_over, tokens_at_most and tokens_over, share (of documents at most so long) and truncated_total, the
    tokens left if every document is cut after n_tokens. Between two lengths of the table the counts stay
    as at the shorter one, so truncated_total(limit) = tokens_at_most + limit * docs_over for any limit.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    counts = stage(counts.withColumn("block", F.expr(f"n_tokens div {BLOCK}")), "lengths")
    held = {"docs": F.col("n_docs"), "tokens": F.col("n_docs") * F.col("n_tokens")}
    blocks = counts.groupBy("block").agg(*[F.sum(x).alias(name) for name, x in held.items()])
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        *[F.coalesce(F.sum(name).over(after), F.lit(0)).alias(f"{name}_after") for name in held],
        *[F.sum(name).over(every).alias(f"all_{name}") for name in held],
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.join(blocks, "block")
    for name, x in held.items():
        sums = sums.withColumn(f"{name}_over", F.coalesce(F.sum(x).over(inside), F.lit(0)) + F.col(f"{name}_after"))
        sums = sums.withColumn(f"{name}_at_most", F.col(f"all_{name}") - F.col(f"{name}_over"))
    return sums.select(
        "n_tokens",
        "n_docs",
        "docs_at_most",
        "docs_over",
        "tokens_at_most",
        "tokens_over",
        (F.col("docs_at_most") / F.col("all_docs")).alias("share"),
        (F.col("tokens_at_most") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, total: tokens left if every document is cut after ``limit`` tokens, for a list of limits."""
    sums = [F.coalesce(F.sum(F.least("n_tokens", F.lit(x)) * F.col("n_docs")), F.lit(0)) for x in limits]
    entries = F.array(*[F.struct(F.lit(x).alias("limit"), total.alias("total")) for x, total in zip(limits, sums)])
    return histogram.agg(entries.alias("e")).select(F.inline("e"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the shortest length that at least so large a share of the documents does not exceed."""
    least = [F.min(F.when(F.col("share") >= x, F.col("n_tokens"))) for x in shares]
    entries = F.array(*[F.struct(F.lit(x).alias("share"), n.alias("n_tokens")) for x, n in zip(shares, least)])
    return histogram.agg(entries.alias("e")).select(F.inline("e"))
