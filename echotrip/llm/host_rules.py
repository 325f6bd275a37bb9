"""Quality rules per text, and the hosts they condemn: failure rates shrunk by an empirical beta prior.

Every text is measured where it lies (whole text, bytes as arrays); the few numbers per text are staged once. Four rules are
aggregated by host: the base rule, which also decides about the text itself, and three that a decent text may break once in a while: many symbols,
many repeated lines, words of odd length. Per rule a beta prior is fitted on the hosts' rates by moments. A host is rejected if under some rule it fails far more
often than the corpus does: if the mean of its posterior, less ``sigmas`` of its deviations, is above ``factor`` times the rate of all.

Hosts cost one map-side aggregation; their staged table goes back by a join that broadcasts it if its size allows, and
otherwise has its large partitions split by adaptive execution.

Defined results: null and empty texts have no words and fail; a null host gives no verdict (the base rule alone decides);
repeated rows each count; an empty table gives an empty result; hosts that all have one rate are not rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrip.llm import arrays
from echotrip.session import stage

# The characters that count as symbols.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Settings:
    least_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    symbol_percent: int = 10  # of the number of words
    line_percent: int = 5  # repeated lines, of the number of words
    word_length: tuple[int, int] = (3, 10)  # shortest and longest mean
    factor: float = 2.0
    sigmas: float = 3.0


RULES = ["base", "symbols", "lines", "lengths"]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(data: np.ndarray, offsets: np.ndarray, window: int) -> list[np.ndarray]:
    n = len(offsets) - 1
    begin, end, owner = arrays.words_of(data, offsets)
    inside = ~arrays.WHITE[data]
    chars = arrays.per_text(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = arrays.per_text(SYMBOLS[data], offsets)
    roll = arrays.Rolling(data)

    breaks = np.flatnonzero(data == 10)
    line_begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([offsets[1:], breaks]))
    # A text that ends in a line break has an empty last line that begins where the next text does; it holds no word.
    held = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    full = line_end > line_begin
    full[full] = held[line_end[full]] > held[line_begin[full]]
    line_begin, line_end = line_begin[full], line_end[full]
    line_owner = np.searchsorted(offsets, line_begin, "right") - 1
    _, later = arrays.repeated(roll.of(line_begin, line_end) ^ arrays.mix(line_owner.astype(np.uint64)))
    dup_lines = np.bincount(line_owner[later], minlength=n)

    windows = arrays.sequence_hash(roll.of(begin, end), window)
    whole = np.flatnonzero(owner[: len(windows)] == owner[window - 1 :][: len(windows)]) if len(windows) else np.zeros(0, np.int64)
    twice, _ = arrays.repeated(windows[whole] ^ arrays.mix(owner[whole].astype(np.uint64)))
    cover = np.zeros(len(begin) + 1, np.int64)
    np.add.at(cover, whole[twice], 1)
    np.add.at(cover, np.minimum(whole[twice] + window, len(begin)), -1)
    repeated = np.bincount(owner[np.cumsum(cover)[:-1] > 0], minlength=n)
    return [np.bincount(owner, minlength=n), chars, symbols, dup_lines, repeated]


def _measure_texts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(data, offsets, window) for _, _, data, offsets in arrays.pieces(batch.column("text"))]
            if parts:
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), *columns], names=["id", "host", *MEASURES])

    return run


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str, s: Settings = Settings()) -> DataFrame:
    """id, host, the five measures and base_failed of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, host string, " + ", ".join(f"{c} bigint" for c in MEASURES)
    measured = rows.mapInArrow(_measure_texts(s.window), schema)
    failed = (F.col("n_words") < s.least_words) | (100 * F.col("n_repeat_words") > s.repeat_percent * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def broken(s: Settings) -> list[Column]:
    """Which of ``RULES`` a measured text breaks. A text without words breaks the base rule only."""
    low, high = s.word_length
    words = F.col("n_words")
    return [
        F.col("base_failed"),
        100 * F.col("n_symbols") > s.symbol_percent * words,
        100 * F.col("n_dup_lines") > s.line_percent * words,
        (F.col("word_chars") < low * words) | (F.col("word_chars") > high * words),
    ]


def host_rates(measured: DataFrame, s: Settings = Settings()) -> DataFrame:
    """host, n_docs, failed (of each rule), rates (shrunk towards the rate of all) and rejected, one row per host.

    A prior's strength is mean * (1 - mean) / variance - 1 of the hosts' rates, weighted by documents, at least 1; without
    variance every host has the mean rate.
    """
    counts = [F.sum(x.cast("bigint")).alias(f"f{i}") for i, x in enumerate(broken(s))]
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), *counts)
    hosts = stage(hosts, "hosts")
    fails = [F.col(f"f{i}") for i in range(len(RULES))]
    total = hosts.agg(F.sum("n_docs").alias("n"), *[F.sum(f).alias(f"f{i}") for i, f in enumerate(fails)]).first()
    means = [total[f"f{i}"] / total.n if total.n else 0.0 for i in range(len(RULES))]
    spread = [F.sum(F.col("n_docs") * F.pow(f / F.col("n_docs") - m, 2)).alias(f"v{i}") for i, (f, m) in enumerate(zip(fails, means))]
    variances = [(v or 0.0) / total.n if total.n else 0.0 for v in hosts.agg(*spread).first()]
    rates, rejected = [], F.lit(False)
    for f, mean, variance in zip(fails, means, variances):
        if variance <= 0:
            rates.append(F.lit(mean))
            continue
        strength = max(1.0, mean * (1 - mean) / variance - 1)
        seen = F.col("n_docs") + strength
        rate = (f + mean * strength) / seen
        rates.append(rate)
        rejected |= rate - s.sigmas * F.sqrt(rate * (1 - rate) / (seen + 1)) > s.factor * mean
    return hosts.select("host", "n_docs", F.array(*fails).alias("failed"), F.array(*rates).alias("rates"), rejected.alias("rejected"))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", settings: Settings = Settings()
) -> DataFrame:
    """One row per row of ``docs``: id, the measures, base_failed, host_rate (of the base rule), host_rejected, kept."""
    measured = stage(measures(docs, id_col, text_col, host_col, settings), "measures")
    hosts = host_rates(measured, settings).select("host", F.col("rates")[0].alias("host_rate"), "rejected")
    hosts = stage(hosts, "verdicts")  # its size is known, so a small one is broadcast before anything is dealt by host
    joined = measured.join(hosts, "host", "left")
    joined = joined.withColumn("host_rejected", F.coalesce("rejected", F.lit(False)))
    joined = joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    return joined.select(F.col("id").alias(id_col), *MEASURES, "base_failed", "host_rate", "host_rejected", "kept")
