"""Sentence and corpus metrics, evaluation report, rubric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrip.functions import ngrams, scores


# Metric name -> kinds of n-grams it is computed from.
METRICS = {"bleu": ["words"], "chrf": ["chars"], "chrf++": ["chars", "peeled"]}


def _kinds(metrics: list[str]) -> list[str]:
    for metric in metrics:
        if metric not in METRICS:
            raise ValueError(f"Unknown metric: {metric}")
    return [k for k in ngrams.ORDERS if any(k in METRICS[m] for m in metrics)]


def _score(metric: str, effective_order: bool, stats: str = "_stats") -> Column:
    if metric == "bleu":
        return scores.bleu_score(F.col(f"{stats}.words"), effective_order)
    peeled = F.col(f"{stats}.peeled") if metric == "chrf++" else None
    return scores.chrf_score(F.col(f"{stats}.chars"), peeled)


def score_pairs(
    pairs: DataFrame, metrics: dict[str, str], hyp: str = "hyp", ref: str = "ref"
) -> DataFrame:
    """Add one score column per entry of ``metrics`` (column name -> metric name).

    Statistics shared by several metrics are computed once, where the row lies: no exchange.
    """
    return score_sides(pairs, {(hyp, ref): metrics})


def score_sides(pairs: DataFrame, sides: dict[tuple[str, str], dict[str, str]]) -> DataFrame:
    """``score_pairs`` for several (hypothesis, reference) columns of a row, which cross to Python together."""
    stats = ngrams.sides_statistics(
        [(F.col(hyp), F.col(ref), _kinds(list(metrics.values()))) for (hyp, ref), metrics in sides.items()]
    )
    scored = [
        _score(m, effective_order=True, stats=f"_stats.s{i}").alias(c)
        for i, metrics in enumerate(sides.values())
        for c, m in metrics.items()
    ]
    return pairs.select("*", stats.alias("_stats")).select(*pairs.columns, *scored)


def sentence_metric(
    pairs: DataFrame, metric: str = "chrf", word_order: int = 2, out: str = "score",
    hyp: str = "hyp", ref: str = "ref",
) -> DataFrame:
    """Add one score by metric name, "bleu" or "chrf" (``word_order`` 2 is chrF++, 0 is chrF);
    other names fail while the plan is built."""
    return sentence_metrics(pairs, {out: (metric, word_order)}, hyp, ref)


def sentence_metrics(
    pairs: DataFrame, wanted: dict[str, tuple[str, int]], hyp: str = "hyp", ref: str = "ref"
) -> DataFrame:
    """``sentence_metric`` for several scores (column name -> metric name and word order), which share their n-gram statistics."""
    names = {out: {("chrf", 2): "chrf++"}.get(named, named[0]) for out, named in wanted.items()}
    return score_pairs(pairs, names, hyp, ref)


def score_pairs_exploded(
    pairs: DataFrame, keys: list[str], metrics: dict[str, str], hyp: str = "hyp", ref: str = "ref"
) -> DataFrame:
    """Same scores from the relational n-gram counts, without Python workers: ``(*keys, scores)``.

    ``keys`` must identify a pair. Every statistic is grouped on the one exchange by ``keys``.
    """
    kinds = _kinds(list(metrics.values()))
    counted = None
    for kind in kinds:
        long = ngrams.exploded_statistics(pairs, keys, kind, hyp, ref)
        wide = ngrams.gather_statistics(long, keys, kind)
        counted = wide if counted is None else counted.join(wide, keys)
    return counted.withColumn("_stats", F.struct(*kinds)).select(
        *keys, *[_score(m, effective_order=True).alias(c) for c, m in metrics.items()]
    )


def score_keyed_pairs(
    pairs: DataFrame, keys: list[str], metrics: dict[str, str], hyp: str = "hyp", ref: str = "ref"
) -> DataFrame:
    """The rows of ``score_pairs_exploded``, of which only rows that share their keys are exploded.

    A key that is there once is scored where its row lies. Statistics of several kinds meet by a join on
    the keys there, so keys with a null have no row then; here neither.
    """
    single, shared = ngrams.single_and_shared(pairs.select(*keys, hyp, ref), keys)
    if len(_kinds(list(metrics.values()))) > 1:
        single, shared = single.dropna(subset=keys), shared.dropna(subset=keys)
    scored = score_pairs(single, metrics, hyp, ref).select(*keys, *metrics)
    return scored.unionByName(score_pairs_exploded(shared, keys, metrics, hyp, ref))


def _summed(kinds: list[str]) -> Column:
    """Element-wise sums of the statistics (fixed-size aggregates, combined map-side)."""
    return F.struct(
        *[
            F.array(
                *[F.sum(F.get(f"_stats.{k}", F.lit(i))) for i in range(3 * ngrams.ORDERS[k])]
            ).alias(k)
            for k in kinds
        ]
    ).alias("_stats")


def corpus_scores(
    pairs: DataFrame, by: list[str], metrics: dict[str, str], hyp: str = "hyp", ref: str = "ref"
) -> DataFrame:
    """Corpus score per group: sentence statistics are summed, then scored once.

    The only exchange carries one row of sums per task and group, whatever the group's size.
    """
    kinds = _kinds(list(metrics.values()))
    counted = pairs.select(
        *by, ngrams.pair_statistics(F.col(hyp), F.col(ref), kinds).alias("_stats")
    )
    return counted.groupBy(*by).agg(_summed(kinds)).select(
        *by, *[_score(m, effective_order=False).alias(c) for c, m in metrics.items()]
    )


def eval_report(frames: DataFrame, by: list[str]) -> DataFrame:
    """Long report ``(*by, direction, metric, score)`` over direction frames.

    ``frames`` has ``direction``, ``target_gold``, ``target_pred`` and the columns ``by``
    (language, split, ...). BLEU for both directions; the character score is chrF++ forward and
    plain chrF backward, and is named so. All groups are scored in one job.
    """
    forward = F.col("direction") == "forward"
    kinds = list(ngrams.ORDERS)
    counted = frames.select(
        *by,
        "direction",
        ngrams.pair_statistics(F.col("target_pred"), F.col("target_gold"), kinds).alias("_stats"),
    )
    summed = counted.groupBy(*by, "direction").agg(_summed(kinds))
    rows = F.array(
        F.struct(F.lit("bleu").alias("metric"), _score("bleu", False).alias("score")),
        F.when(
            forward,
            F.struct(F.lit("chrf++").alias("metric"), _score("chrf++", False).alias("score")),
        ).otherwise(F.struct(F.lit("chrf").alias("metric"), _score("chrf", False).alias("score"))),
    )
    return summed.select(*by, "direction", F.inline(rows))


def rubric(
    rollouts: DataFrame, rewards: list[tuple[Column, float]], env: list[str], example: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Weighted sum of reward columns, averaged over the rollouts of each example and then over
    the examples of each environment: ``(per_example, per_env)`` with column ``reward``."""
    total = sum((column * weight for column, weight in rewards), start=F.lit(0.0))
    per_example = (
        rollouts.select(*env, *example, total.alias("reward"))
        .groupBy(*env, *example)
        .agg(F.avg("reward").alias("reward"), F.count("*").alias("n_rollouts"))
    )
    per_env = per_example.groupBy(*env).agg(
        F.avg("reward").alias("reward"), F.count("*").alias("n_examples")
    )
    return per_example, per_env
