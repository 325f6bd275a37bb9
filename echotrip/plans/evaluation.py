"""Matched pairs -> greedy translation both ways -> report per language and direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrip.operators.candidates import Factory, greedy
from echotrip.operators.metrics import eval_report
from echotrip.operators.prompts import backward_prompt, forward_prompt
from echotrip.operators.reports import direction_frames
from echotrip.session import spread, stage


def predictions(
    pairs: DataFrame, factory: Factory, style: str = "plain", model: str | None = None,
    stop: str | None = "\n",
) -> DataFrame:
    """Greedy predictions for matched pairs (lang, lang_name, id, split, text_tgt, text_eng).

    All languages in one job. Staged, since the report and the preview both read it.
    """
    model_col = None if model is None else F.lit(model)
    asked = spread(pairs, "lang", "id").select(
        "lang", "split", "id",
        F.col("text_eng").alias("eng"),
        F.col("text_tgt").alias("tgt"),
        forward_prompt(F.col("text_eng"), F.col("lang_name"), style, model_col).alias("fwd_prompt"),
        backward_prompt(F.col("text_tgt"), F.col("lang_name"), style, model_col).alias("bwd_prompt"),
    )
    keys = ["lang", "split", "id"]
    there = greedy(asked, factory, "fwd_prompt", "fwd_pred", keys, stop=stop)
    both = greedy(there, factory, "bwd_prompt", "bwd_pred", keys, stop=stop)
    return stage(both.drop("fwd_prompt", "bwd_prompt"), "predictions")


def run(pairs: DataFrame, factory: Factory, **how) -> tuple[DataFrame, DataFrame]:
    """``(frames, report)``; the report is per language, split, direction and metric."""
    frames = direction_frames(predictions(pairs, factory, **how), "lang", "split", "id")
    return frames, eval_report(frames, ["lang", "split"])
