"""Chat transcripts ``(conv_id, turn, role, text)``: final answers and follow-up turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrip.functions.text import visible_answer
from echotrip.operators.prompts import DEFAULT_LANGUAGE, backward_prompt


def final_answers(transcripts: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """``(*keys, last_turn, answer)``: last assistant message without its reasoning block.

    NULL where a conversation has no assistant turn. One aggregation with map-side combine, so a
    conversation of any length never gathers in a task.
    """
    said = F.when(F.col("role") == "assistant", F.col("turn"))
    return transcripts.groupBy(*keys).agg(
        F.max("turn").alias("last_turn"),
        F.max_by("text", said).alias("answer"),
    ).withColumn("answer", visible_answer(F.col("answer")))


def next_turn(transcripts: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """The user turn asking to translate the last answer back.

    ``info`` holds ``(conv_id, info)`` with the language name in JSON; without it, or without a
    name in it, a generic wording is used. Conversations without an answer get no turn.
    """
    answers = final_answers(transcripts).where(F.col("answer").isNotNull())
    answers = (
        answers.withColumn("info", F.lit(None).cast("string"))
        if info is None
        else answers.join(info.select("conv_id", "info"), "conv_id", "left")
    )
    name = F.coalesce(F.get_json_object("info", "$.lang_name"), F.lit(DEFAULT_LANGUAGE))
    return answers.select(
        "conv_id",
        (F.col("last_turn") + 1).alias("turn"),
        F.lit("user").alias("role"),
        backward_prompt(F.col("answer"), name, "instruct").alias("text"),
    )


def extend(transcripts: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Transcripts with the follow-up turn appended."""
    return transcripts.select("conv_id", "turn", "role", "text").unionByName(
        next_turn(transcripts, info)
    )
