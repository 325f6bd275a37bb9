"""Analytics over logged token log-probabilities: masks, clipped objective, KL, step log.

Sequences are ragged arrays, one row per sequence; everything per token is an array expression, so
tokens are never exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Clipping range, weight of the KL term, share of the forward loss.
EPSILON = 0.2
BETA = 0.1
ALPHA = 0.0


def tail_mask(length: Column, completion_len: Column) -> Column:
    """1 for the last ``completion_len`` of ``length`` positions (left-padded sequence)."""
    ones = F.least(F.greatest(completion_len, F.lit(0)), length)
    return F.concat(F.array_repeat(F.lit(0), length - ones), F.array_repeat(F.lit(1), ones))


def label_mask(labels: Column, pad: int) -> Column:
    """1 where a label is not padding (encoder-decoder form)."""
    return F.transform(labels, lambda label: (label != pad).cast("int"))


def empty_completions(df: DataFrame, completion_len: str, mask: str | None = None) -> DataFrame:
    """Rows without a usable completion, with the reason."""
    reason = F.when(F.col(completion_len) <= 0, "no_tokens")
    if mask is not None:
        reason = F.coalesce(
            reason, F.when(~F.exists(mask, lambda m: m > 0), "mask_all_zero")
        )
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def sequence_text(prompt: Column, completion: Column) -> Column:
    return F.concat(prompt, F.lit(" "), completion)


def _zip(function, first: str | Column, second: str | Column) -> Column:
    return F.zip_with(first, second, function)


def policy_ratio(policy: str = "policy", old: str = "old") -> Column:
    return _zip(lambda p, o: F.exp(p - o), policy, old)


def clipped_objective(ratio: Column, advantage: Column, epsilon: float = EPSILON) -> Column:
    """min(ratio * A, clip(ratio) * A) per token."""
    def term(r: Column) -> Column:
        clipped = F.least(F.greatest(r, F.lit(1 - epsilon)), F.lit(1 + epsilon))
        return F.least(r * advantage, clipped * advantage)

    return F.transform(ratio, term)


def kl_estimate(policy: str = "policy", ref: str = "ref") -> Column:
    """exp(d) - d - 1 with d = ref - policy, per token."""
    return _zip(lambda p, r: F.exp(r - p) - (r - p) - 1, policy, ref)


def token_loss(objective: Column, kl: Column, beta: float = BETA) -> Column:
    if beta > 0:
        return _zip(lambda o, k: k * beta - o, objective, kl)
    return F.transform(objective, lambda o: -o)


def masked_mean(values: Column, mask: str | Column) -> Column:
    """Mean over the unmasked tokens; NULL if none."""
    return F.try_divide(_masked_total(values, mask), _masked_count(mask))


def _masked_total(values: Column, mask: str | Column) -> Column:
    return F.aggregate(_zip(lambda v, m: v * m, values, mask), F.lit(0.0), lambda a, v: a + v)


def _masked_count(mask: str | Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, m: a + m)


def sequence_terms(
    sequences: DataFrame, advantage: str = "advantage", epsilon: float = EPSILON, beta: float = BETA
) -> DataFrame:
    """Add ``loss`` and ``kl`` per sequence (means over its completion tokens).

    ``sequences`` has arrays ``old``, ``policy``, ``ref``, ``mask`` and the sequence's advantage.
    """
    objective = clipped_objective(policy_ratio(), F.col(advantage), epsilon)
    # Both means need these; as columns they are made once a row.
    made = sequences.select("*", kl_estimate().alias("_kl"), _masked_count("mask").alias("_count"))
    loss = _masked_total(token_loss(objective, F.col("_kl"), beta), "mask")
    return made.select(
        *sequences.columns,
        F.try_divide(loss, "_count").alias("loss"),
        F.try_divide(_masked_total(F.col("_kl"), "mask"), "_count").alias("kl"),
    )


def mean_loss(terms: DataFrame, by: list[str]) -> DataFrame:
    """Mean over sequences, so each weighs the same whatever its length."""
    return terms.groupBy(*by).agg(
        F.avg("loss").alias("loss"),
        F.avg("kl").alias("kl"),
        F.count("loss").alias("n_sequences"),
        F.count_if(F.col("loss").isNull()).alias("n_empty"),
    )


def direction_weight(direction: Column, alpha: float = ALPHA) -> Column:
    return F.when(direction == "forward", F.lit(alpha)).otherwise(F.lit(1 - alpha))


def mix_directions(losses: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """alpha * forward + (1 - alpha) * backward; a direction of weight 0 is not read at all."""
    direction = F.col("direction")
    used = losses
    if alpha <= 0:
        used = losses.where(direction != "forward")
    if alpha >= 1:
        used = losses.where(direction == "forward")
    return used.groupBy(*by).agg(
        F.sum(F.col("loss") * direction_weight(direction, alpha)).alias("loss")
    )


def step_log(batches: DataFrame, grad_acc_steps: int, alpha: float = ALPHA) -> DataFrame:
    """Per-step log from per-batch rows.

    ``batches``: epoch, batch (running number over all epochs), fwd_loss, bwd_loss, fwd_kl,
    bwd_kl, reward_bleu, reward_chrf. A step covers ``grad_acc_steps`` consecutive batches and is
    logged under the epoch of its last batch; trailing batches that fill no step are not logged.
    """
    def per_step(value: str, weight: float = 1.0) -> Column:
        return (F.sum(F.coalesce(F.col(value), F.lit(0.0))) * weight / grad_acc_steps).alias(value)

    return (
        batches.groupBy(F.floor(F.col("batch") / grad_acc_steps).alias("step"))
        .agg(
            F.max("epoch").alias("epoch"),
            per_step("fwd_loss", alpha),
            per_step("bwd_loss", 1 - alpha),
            per_step("fwd_kl"),
            per_step("bwd_kl"),
            per_step("reward_bleu"),
            per_step("reward_chrf"),
            F.count("*").alias("n_batches"),
        )
        .where(F.col("n_batches") == grad_acc_steps)
        .drop("n_batches")
    )


def epoch_log(steps: DataFrame) -> DataFrame:
    """Sums of the step rewards per epoch."""
    return steps.groupBy("epoch").agg(
        F.sum("reward_bleu").alias("reward_bleu"),
        F.sum("reward_chrf").alias("reward_chrf"),
        F.count("*").alias("n_steps"),
    )
