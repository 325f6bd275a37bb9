"""Chat formatting by multi-party perspective rotation.

For every speaker of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users; a mask marks what the assistant says. Speakers are the distinct roles but ``system``, whose turns stay system turns.
A dialogue is cut into blocks of ``block`` turn numbers, and a block of many rows (repeated or null numbers) into parts of ``lines`` rows,
each a row with its place in the whole. So neither a conversation nor a block of any size meets in one task: lines are gathered once
per part, before they are rendered for each speaker, and places come from sums over the parts' lengths, without their texts.

Defined results: a null text is an empty turn; a null role is the speaker ``unknown``; null turns come first; turns of one number
(repeated rows too) follow by role, then text; a conversation of system turns only, and an empty table, give no rows;
rows without a conversation id are left out; columns other than the four named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotrip.operators.numbering import index_rows
from echotrip.session import stage

SYSTEM = "system"
BLOCK = 256
LINES = 1024
END = "<|end|>\n"


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block: int = BLOCK,
    lines: int = LINES,
) -> DataFrame:
    """conv, speaker, block, part, n_turns, text, mask (begin and end of the assistant's characters in the whole dialogue), start, n_masked.

    A turn is rendered as ``<|role|>`` with ``:name`` for users, a line break, the text, ``<|end|>`` and a line break. Masked characters are
    the assistant's text with its end mark. Texts of a dialogue's blocks and parts, joined in order, are the dialogue.
    """
    said = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    said = said.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("bigint"))
    # Only blocks of more rows than a part are numbered.
    large = said.groupBy("conv", "block").agg(F.count("*").alias("n")).where(F.col("n") > lines).select("conv", "block")
    large = stage(large, "large")
    numbered = index_rows(said.join(large, ["conv", "block"], "left_semi"), ["turn", "role", "text"], "place", within=("conv", "block"))
    columns = ["conv", "block", "turn", "role", "text"]
    parts = said.join(large, ["conv", "block"], "left_anti").select(*columns, F.lit(0).cast("bigint").alias("part"))
    parts = parts.union(numbered.select(*columns, F.floor(F.col("place") / lines).cast("bigint")))
    key = ["conv", "block", "part"]
    grouped = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("lines"))
    grouped = stage(grouped, "lines")

    # Lengths of the parts: as all see them, and what differs for the one who speaks.
    as_user = F.when(F.col("role") == SYSTEM, len("<|system|>\n")).otherwise(F.length("role") + len("<|user:|>\n"))
    length = F.col("n_chars") + as_user + len(END)
    spoken = grouped.select(*key, F.explode(F.transform("lines", lambda x: F.struct(x["role"].alias("role"), F.length(x["text"]).alias("n_chars")))).alias("x"))
    spoken = spoken.select(*key, "x.*").groupBy(*key, "role").agg(
        F.sum(length).alias("shared"), F.sum(len("<|assistant|>\n") - as_user).alias("own")
    )
    spoken = stage(spoken, "lengths")
    speakers = spoken.where(F.col("role") != SYSTEM).select("conv", F.col("role").alias("speaker")).distinct()
    shared = spoken.groupBy(*key).agg(F.sum("shared").alias("shared")).join(speakers, "conv")
    own = spoken.select(*key, F.col("role").alias("speaker"), "own")
    sized = shared.join(own, [*key, "speaker"], "left").select(*key, "speaker", (F.col("shared") + F.coalesce("own", F.lit(0))).alias("size"))
    before = Window.partitionBy("conv", "speaker").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.select(*key, "speaker", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))

    def head(x):
        other = F.when(x["role"] == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), x["role"], F.lit("|>\n")))
        return F.when(x["role"] == F.col("speaker"), F.lit("<|assistant|>\n")).otherwise(other)

    placed = grouped.join(stage(starts, "starts"), key)
    shown = F.transform("lines", lambda x: F.concat(head(x), x["text"], F.lit(END)))
    placed = placed.withColumn("text", F.array_join(shown, ""))
    # Running over the lines: where the next one begins, and the assistant's ranges so far.
    empty = F.struct(
        F.col("start").cast("bigint").alias("at"),
        F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)").alias("mask"),
    )

    def step(state, x):
        begin = state["at"] + F.length(head(x))
        end = begin + F.length(x["text"]) + F.lit(len("<|end|>"))
        own = F.array(F.struct(begin.cast("bigint").alias("begin"), end.cast("bigint").alias("end")))
        mask = F.when(x["role"] == F.col("speaker"), F.concat(state["mask"], own)).otherwise(state["mask"])
        return F.struct((end + 1).cast("bigint").alias("at"), mask.alias("mask"))

    mask = F.aggregate("lines", empty, step, lambda state: state["mask"])
    done = placed.select("conv", "speaker", "block", "part", F.size("lines").alias("n_turns"), "start", "text", mask.alias("mask"))
    masked = F.aggregate("mask", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["begin"])
    return done.select(
        F.col("conv").alias(conv_col),
        "speaker",
        F.when(F.col("block") == -(1 << 62), F.lit(None)).otherwise(F.col("block")).alias("block"),
        "part",
        F.col("n_turns").cast("bigint").alias("n_turns"),
        F.col("start").cast("bigint").alias("start"),
        "text",
        "mask",
        masked.alias("n_masked"),
    )
