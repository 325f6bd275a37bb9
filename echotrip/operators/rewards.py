"""Round-trip rewards, group-relative advantages and z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrip.functions import exact
from echotrip.operators.metrics import score_pairs

# Floor of the group deviation, and the metrics a training reward has.
STD_FLOOR = 1e-8
REWARD_METRICS = {"bleu": "bleu", "chrf": "chrf++"}


def cycle_rewards(rollouts: DataFrame, *keep: str) -> DataFrame:
    """Score every back-translation against its own sentence, where the row lies.

    ``rollouts`` is the long table with ``sentence`` and ``bwd_text``; texts are dropped from the
    result, which later steps read several times.
    """
    scored = score_pairs(rollouts, REWARD_METRICS, "bwd_text", "sentence")
    return scored.select("sent_id", "fwd_idx", "bwd_idx", *REWARD_METRICS, *keep)


def pair_with_source(back: DataFrame, sentences: DataFrame) -> DataFrame:
    """Join back-translations stored without their sentence to the sentences, on ``sent_id``."""
    return back.join(sentences.select("sent_id", "sentence"), "sent_id")


def forward_rewards(
    rewards: DataFrame, keys: tuple[str, ...] = ("sent_id", "fwd_idx"), how: str = "mean"
) -> DataFrame:
    """Reward of a forward candidate: mean (or sum) over its back-translations, the same in any order of rows."""
    fold = {"mean": exact.mean, "sum": exact.total}[how]
    sums = rewards.groupBy(*keys).agg(*[x for m in REWARD_METRICS for x in exact.sums(m, f"_{m}")])
    return sums.select(*keys, *[fold(f"_{m}").alias(m) for m in REWARD_METRICS])


def with_group_moments(df: DataFrame, keys: list[str], values: list[str], in_place: bool = False) -> DataFrame:
    """Add count, mean, sample deviation, min and max of each value within its group.

    One way for groups of every size: moments come from an aggregation with map-side combine and go back by a
    join on the keys, whose large partitions adaptive execution splits; no window gathers a group. Moments are
    formed from whole numbers, so they are the same bits in any order of rows. Null
    keys are a group. Reads ``df`` twice, so stage it if it is expensive.

    ``in_place``: for rows of which whole groups lie in one task already, as they do after the fan-out of a sentence (partitioned by
    some of the keys). Rows are then read once and sorted within their task, and nothing is exchanged; a large group goes to disk
    in part, but is not split.
    """
    if in_place:
        over = Window.partitionBy(*keys)
        columns = {"_n": F.count(F.lit(1)).over(over)}
        for v in values:
            columns.update(exact.window_sums(v, f"_{v}", over))
        wide = df.withColumns(columns)
        moments = [x for v in values for x in (exact.mean(f"_{v}").alias(f"_{v}_mean"), exact.deviation(f"_{v}").alias(f"_{v}_std"), f"_{v}_min", f"_{v}_max")]
        return wide.select(*df.columns, "_n", *moments)
    names = {k: f"_key_{k}" for k in keys}
    sums = df.groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(
        F.count("*").alias("_n"), *[x for v in values for x in exact.sums(v, f"_{v}")]
    )
    made = [c for v in values for c in (exact.mean(f"_{v}").alias(f"_{v}_mean"), exact.deviation(f"_{v}").alias(f"_{v}_std"))]
    ends = [f"_{v}_{end}" for v in values for end in ("min", "max")]
    moments = sums.select(*names.values(), "_n", *made, *ends)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return df.join(moments, same).select(*df.columns, "_n", *[f"_{v}_{x}" for v in values for x in ("mean", "std", "min", "max")])


def _standardised(value: str, constant: Column, spread: Column) -> Column:
    """(value - mean) / spread; groups of one or of equal values give ``constant``.

    Equality is tested on min and max: the rounded mean of equal values can miss them.
    """
    flat = (F.col("_n") == 1) | (F.col(f"_{value}_min") == F.col(f"_{value}_max"))
    z = F.try_divide(F.col(value) - F.col(f"_{value}_mean"), spread)
    return F.when(flat, constant).otherwise(z)


def advantages(
    rewards: DataFrame, keys: list[str], metrics: tuple[str, ...] = ("bleu", "chrf"), in_place: bool = False
) -> DataFrame:
    """Add ``adv_<metric>`` and ``group_size``: reward relative to its group of siblings.

    ``keys`` is ``["sent_id"]`` for forward candidates and ``["sent_id", "fwd_idx"]`` for
    back-translations. A group of one, or of equal rewards, has advantage 0. ``in_place`` as in ``with_group_moments``.
    """
    moments = with_group_moments(rewards, keys, list(metrics), in_place)
    return moments.select(
        *rewards.columns,
        *[
            _standardised(m, F.lit(0.0), F.greatest(F.col(f"_{m}_std"), F.lit(STD_FLOOR))).alias(
                f"adv_{m}"
            )
            for m in metrics
        ],
        F.col("_n").alias("group_size"),
    )


def chosen_advantage(metric: str, bleu: str = "adv_bleu", chrf: str = "adv_chrf") -> Column:
    """Advantage by reward metric: "bleu", "chrf" or "both" (unweighted mean)."""
    choices = {
        "bleu": F.col(bleu),
        "chrf": F.col(chrf),
        "both": (F.col(bleu) + F.col(chrf)) / 2,
    }
    if metric not in choices:
        raise ValueError(f"Unknown metric: {metric}")
    return choices[metric]


def group_zscores(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Replace each value by its z-score in the group; NULL where the group does not vary."""
    moments = with_group_moments(df, keys, values)
    none = F.lit(None).cast("double")
    scored = {v: _standardised(v, none, F.col(f"_{v}_std")) for v in values}
    return moments.select(*[scored[c].alias(c) if c in scored else c for c in df.columns])
