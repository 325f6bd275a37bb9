"""Corpus -> sentences -> rollouts -> rewards -> advantages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrip.operators import candidates, rewards
from echotrip.operators.sentences import first_sentences
from echotrip.session import stage
from echotrip.sources.languages import require_languages, with_language_name

# Fixed value: sentences a run trains on.
NUM_SENTENCES = 20_000


def prepare(
    corpus: DataFrame, languages: DataFrame, lang: str, n: int = NUM_SENTENCES, **extract
) -> DataFrame:
    """First ``n`` sentences of the corpus with the target language's code and name."""
    rows = first_sentences(corpus, n, **extract).withColumn("lang", F.lit(lang))
    require_languages(languages.sparkSession.createDataFrame([(lang,)], "code STRING"), languages)
    return with_language_name(rows, languages)


def reward_tables(rollouts: DataFrame, metric: str = "both") -> dict[str, DataFrame]:
    """Tables ``backward`` and ``forward`` with rewards, advantages and the chosen ``advantage``.

    Scores are computed once and staged; both directions and both passes of the group statistics
    read the small staged table.
    """
    scored = stage(rewards.cycle_rewards(rollouts), "rewards")
    chosen = rewards.chosen_advantage(metric)
    backward = rewards.advantages(scored, ["sent_id", "fwd_idx"])
    forward = rewards.advantages(rewards.forward_rewards(scored), ["sent_id"])
    return {
        "backward": backward.withColumn("advantage", chosen),
        "forward": forward.withColumn("advantage", chosen),
    }


def run(sentences: DataFrame, factory: candidates.Factory, metric: str = "both", **how) -> dict[str, DataFrame]:
    """Rollouts of ``sentences`` (sent_id, lang, lang_name, sentence) and their reward tables."""
    rollouts = candidates.rollout(sentences, factory, **how)
    return {"rollouts": rollouts, **reward_tables(rollouts, metric)}
