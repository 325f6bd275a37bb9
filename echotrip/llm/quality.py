"""Quality classifier from positive and unlabelled texts, by non-negative risk.

Known good texts (positives) and unlabelled web text train a score f under the loss 1 / (1 + exp(f)). With class prior p the risk
p E+[loss(f)] + max(0, E_u[loss(-f)] - p E+[loss(-f)]) is that of labelled training as far as the second term, the negatives' part,
is not below zero; when it is, its gradient is reversed until it is not, so that a flexible score cannot make it negative.
The prior is the share of good ones among labelled texts less two standard errors (too high a prior stops the second term
early), which is all that bad labels are used for.

Scores look at the whole text: shapes of words and lines, repetition, symbols, case. Training collects numbers of at most about
``sample`` positives and ``sample`` unlabelled texts, drawn by a hash of the id; everything else covers all rows.

Defined results: null and empty texts get the score of a text without words; repeated rows are scored each; without
positives every score is the prior; an empty table gives an empty result; of several labels of one id the lowest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrip.llm import arrays

CLASSES = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "stop": np.isin(np.arange(256), np.frombuffer(b".,;:", np.uint8)),
    "loud": np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8)),
    "symbol": np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>@_=+{}[]\\^~/", np.uint8)),
    "beyond": np.arange(256) >= 128,
    "bar": np.isin(np.arange(256), np.frombuffer(b"|>\t", np.uint8)),
    "line": np.arange(256) == 10,
}


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000
    prior: float | None = None  # None: estimated from the labels
    steps: int = 400
    rate: float = 0.05
    decay: float = 3e-3  # at least; with few positives one over their number
    threshold: float = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers per text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    begin, end, owner = arrays.words_of(data, offsets)
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)
    length = (end - begin).astype(np.float64)
    mean = np.bincount(owner, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some - mean**2, 0))
    hashes = arrays.Rolling(data).of(begin, end)
    salted = arrays.mix(owner.astype(np.uint64))
    _, later = arrays.repeated(hashes ^ salted)
    echo = np.zeros(len(owner), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    pairs = arrays.sequence_hash(hashes, 3)
    whole = np.flatnonzero(owner[: len(pairs)] == owner[2:]) if len(pairs) else np.zeros(0, np.int64)
    _, again = arrays.repeated(pairs[whole] ^ salted[whole])
    counts = {name: arrays.per_text(flags[data], offsets) for name, flags in CLASSES.items()}
    letters = np.maximum(size - counts["digit"] - counts["symbol"], 1)
    columns = [
        np.log1p(words),
        mean,
        spread,
        np.bincount(owner[length > 18], minlength=n) / some,
        np.bincount(owner[later], minlength=n) / some,
        np.bincount(owner[echo], minlength=n) / some,
        np.bincount(owner[whole[again]], minlength=n) / some,
        counts["upper"] / letters,
        counts["digit"] / size,
        counts["stop"] / some,
        counts["loud"] / some,
        counts["symbol"] / some,
        counts["beyond"] / size,
        np.log1p(counts["line"]) - np.log1p(words),
        (words == 0).astype(float),
        counts["bar"] / some,
        np.bincount(owner[length == 1], minlength=n) / some,
    ]
    base = np.stack(columns, axis=1)
    shares = base[:, [3, 5, 6, 7, 8, 10, 11, 15, 16]]
    return np.concatenate([base, np.sqrt(shares), base[:, :3] ** 2, base[:, [4]] * base[:, [0]]], axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [features(data, offsets) for _, _, data, offsets in arrays.pieces(batch.column("text"))]
        if parts:
            table = np.concatenate(parts)
            ends = pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1])
            rows = pa.ListArray.from_arrays(ends, pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), rows], names=["id", "x"])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_risk(good: np.ndarray, unknown: np.ndarray, prior: float, s: Settings) -> Model:
    """Minimise the non-negative risk of a linear logistic score by Adam on all rows at once."""
    if not len(good) or not len(unknown):
        width = max(good.shape[-1], unknown.shape[-1])
        bias = float(np.log(prior / (1 - prior)))
        return Model(np.zeros(width), np.ones(width), np.zeros(width), bias, prior)
    mean, scale = unknown.mean(axis=0), unknown.std(axis=0) + 1e-9
    shape = lambda x: np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], axis=1)
    p, u = shape(good), shape(unknown)
    decay = max(s.decay, 1 / len(p))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, s.steps + 1):
        yes_p, yes_u = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (p, u))
        flat_p, flat_u = yes_p * (1 - yes_p), yes_u * (1 - yes_u)
        negative = yes_u.mean() - prior * yes_p.mean()
        down = (u.T @ flat_u) / len(u) - prior * (p.T @ flat_p) / len(p)
        up = -prior * (p.T @ flat_p) / len(p)
        slope = up + down if negative >= 0 else -down
        slope[:-1] += decay * w[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        rate = s.rate / (1 + 4 * t / s.steps)
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()) -> Model:
    """``labels`` (id, 1 good / 0 bad) are those that may be learnt from; ``docs`` are the unlabelled texts and hold the labelled ones."""
    s = settings
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    counted = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("y") == 1).cast("int")), F.lit(0)).alias("good")).first()
    prior = s.prior if s.prior is not None else (counted.good + 1) / (counted.n + 2)
    if s.prior is None:
        prior -= 2 * (prior * (1 - prior) / (counted.n + 2)) ** 0.5
    prior = min(max(prior, 0.01), 0.99)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n_docs = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(1 << 20)) / float(1 << 20)
    take_good, take_any = s.sample / max(counted.good, 1), s.sample / max(n_docs, 1)
    drawn = rows.where(draw < max(take_good, take_any))
    shown = drawn.mapInArrow(_features, f"id {dict(rows.dtypes)['id']}, x array<double>")
    shown = shown.join(known, "id", "left").withColumn("draw", draw)
    shown = shown.where((F.col("draw") < take_any) | ((F.col("y") == 1) & (F.col("draw") < take_good)))
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    table = shown.select("id", "x", "draw", ((F.col("y") == 1) & (F.col("draw") < take_good)).alias("good")).toArrow()
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    order = np.argsort(table["id"].to_numpy(), kind="stable")
    x, at = x[order], table["draw"].to_numpy()[order]
    good = table["good"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)[order]
    return fit_risk(x[good], x[at < take_any], prior, s)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """id, score and predicted of every row, from the whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(features(data, offsets)) for _, _, data, offsets in arrays.pieces(batch.column("text"))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(parts))], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Rows of ``docs``, all columns, whose score reaches the threshold; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(features(data, offsets)) for _, _, data, offsets in arrays.pieces(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= settings.threshold))

    return docs.mapInArrow(run, docs.schema)
