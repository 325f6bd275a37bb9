"""Matched pairs -> candidates -> z-scored metrics -> how round-trip tracks gold."""

from __future__ import annotations

from pyspark.sql import DataFrame

from echotrip.operators import numbering, regression
from echotrip.operators.candidates import MAX_NEW_TOKENS, Factory, rollout
from echotrip.operators.metrics import score_sides
from echotrip.operators.rewards import group_zscores
from echotrip.session import stage

SCORES = ["bleu", "roundtrip_bleu", "chrf", "roundtrip_chrf"]


def sample_candidates(pairs: DataFrame, factory: Factory, n: int, **how) -> DataFrame:
    """``n`` sampled translations of each pair's English side with one greedy back-translation,
    joined to the pair's gold target. ``pairs``: sent_id, lang, lang_name, text_eng, text_tgt."""
    asked = pairs.select("sent_id", "lang", "lang_name", pairs["text_eng"].alias("sentence"))
    rolled = rollout(
        asked, factory, n, greedy_backward=True, greedy_tokens=MAX_NEW_TOKENS, **how
    )
    gold = pairs.select("sent_id", pairs["text_tgt"].alias("gold"))
    return rolled.withColumnRenamed("sentence", "source").join(gold, "sent_id")


def candidate_scores(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, fwd_idx, scores)``: each candidate against the gold target, its greedy
    back-translation against the source. Needs gold, source, fwd_text and bwd_text."""
    sides = {
        ("fwd_text", "gold"): {"bleu": "bleu", "chrf": "chrf++"},
        ("bwd_text", "source"): {"roundtrip_bleu": "bleu", "roundtrip_chrf": "chrf++"},
    }
    both = score_sides(candidates, sides)
    return both.select(*keys, "fwd_idx", *SCORES)


def metric_table(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The correlation table: z-scores within each sentence's candidates and ``sent_idx``."""
    scores = stage(candidate_scores(candidates, keys), "scores")
    return numbering.sentence_index(group_zscores(scores, keys, SCORES), keys)


def run(candidates: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The table plus regression, fitted line and mixed model for each metric."""
    table = stage(metric_table(candidates, keys), "correlation")
    results = {"table": table}
    for metric, (x, y) in regression.PAIRS.items():
        rows = regression.finite_rows(table, metric)
        results[f"{metric}_regression"] = regression.with_p_value(
            regression.linear_regression(rows, x, y)
        )
        results[f"{metric}_line"] = regression.fit_line(rows, x, y)
        results[f"{metric}_mixed"] = regression.mixed_model(rows, x, y)
    return results
