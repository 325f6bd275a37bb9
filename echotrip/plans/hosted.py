"""The two chat environments: rows to ask, follow-up turns, scored transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrip.operators import metrics, prompts, transcripts
from echotrip.plans.training import prepare
from echotrip.sources.languages import require_languages, with_language_name


def monolingual_rows(
    corpus: DataFrame, languages: DataFrame, lang: str, n: int = 10_000
) -> DataFrame:
    """``(sent_id, prompt, answer, info)``: translate there; the answer is the sentence itself."""
    return prompts.chat_rows_monolingual(prepare(corpus, languages, lang, n), "sent_id")


def parallel_rows(pairs: DataFrame, languages: DataFrame, direction: str = "forward") -> DataFrame:
    """``(lang, id, direction, prompt, answer, info)`` of matched pairs, all languages at once."""
    require_languages(pairs.select(F.col("lang").alias("code")), languages)
    named = with_language_name(pairs, languages).withColumn("direction", F.lit(direction))
    return prompts.chat_rows_parallel(named, "lang", "id")


def score_transcripts(
    chats: DataFrame, answers: DataFrame, metric: str = "chrf", scale: float = 1.0
) -> DataFrame:
    """``(conv_id, answer, expected, reward, answered)``: last reply against the expected answer.

    ``answers`` holds (conv_id, expected). The reward is plain chrF or BLEU on 0-100, times
    ``scale``. A conversation without a reply has reward 0 and ``answered`` false; one without an
    expected answer has a NULL reward.
    """
    replies = transcripts.final_answers(chats).select("conv_id", "answer")
    paired = replies.join(answers, "conv_id", "left").withColumn("answered", F.col("answer").isNotNull())
    asked = paired.withColumn("_hyp", F.coalesce("answer", F.lit(""))).withColumn("_ref", F.coalesce("expected", F.lit("")))
    scored = metrics.sentence_metric(asked, metric, 0, "reward", "_hyp", "_ref")
    reward = F.when(F.col("expected").isNull(), None).when(F.col("answered"), F.coalesce("reward", F.lit(0.0)) * scale)
    return scored.select("conv_id", "answer", "expected", reward.otherwise(0.0).alias("reward"), "answered")
