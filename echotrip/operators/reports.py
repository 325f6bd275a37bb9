"""Direction frames, previews and the example table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def direction_frames(predictions: DataFrame, *keep: str) -> DataFrame:
    """``(direction, source, target_gold, target_pred)`` in long form.

    ``predictions`` has eng, tgt, fwd_pred (English -> target) and bwd_pred (target -> English).
    One scan: each pair becomes two rows in place.
    """
    def frame(direction: str, source: str, gold: str, pred: str) -> Column:
        return F.struct(
            F.lit(direction).alias("direction"),
            F.col(source).alias("source"),
            F.col(gold).alias("target_gold"),
            F.col(pred).alias("target_pred"),
        )

    return predictions.select(
        *keep,
        F.inline(
            F.array(
                frame("forward", "eng", "tgt", "fwd_pred"),
                frame("backward", "tgt", "eng", "bwd_pred"),
            )
        ),
    )


def preview(df: DataFrame, by: list[str], order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows of each group. Spark applies the limit before the exchange too, so a
    group's rows do not gather in one task."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def first_sentence_ids(sentences: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """``(sent_id, example_idx)`` of the first ``n`` sentences by ``order``."""
    order = [c for c in order if c != "sent_id"] + ["sent_id"]
    first = sentences.select(*order).distinct().orderBy(*order).limit(n)
    rank = F.row_number().over(Window.orderBy(*order)) - 1  # over n rows
    return first.select("sent_id", rank.alias("example_idx"))


def example_table(rollouts: DataFrame, rewards: DataFrame, shown: DataFrame | list[str]) -> DataFrame:
    """All candidates of the ``shown`` sentences (sent_id, example_idx) with their first back-translation.

    ``shown`` may also be the columns that order the sentences; then the first five are shown. ``rewards`` holds the
    forward rewards (sent_id, fwd_idx, bleu, chrf); only those of shown sentences are needed, so score only these.
    """
    if not isinstance(shown, DataFrame):
        shown = first_sentence_ids(rollouts, shown)
    first = rollouts.where(F.col("bwd_idx") == 0).join(shown, "sent_id")
    return rewards.join(first, ["sent_id", "fwd_idx"]).select(
        F.col("sentence").alias("original_english"),
        F.col("example_idx").alias("fwd_idx"),
        F.col("fwd_text").alias("predicted_target"),
        F.col("fwd_idx").alias("bwd_idx"),
        F.col("bwd_text").alias("final_predicted_english"),
        "bleu",
        "chrf",
    )
