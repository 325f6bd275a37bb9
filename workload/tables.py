"""Input tables of the registered queries, derived from the given tables by Spark.

The given data holds no translations, so word-dropping rewrites stand in for candidates. All rows
and whole texts are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrip.functions.text import words
from echotrip.operators.candidates import fan_out
from echotrip.operators.sentences import extract_sentences
from echotrip.session import spread
from echotrip.sources.corpora import pair_columns, parallel_pairs, read_corpus

LANGUAGES = [("en", "English"), ("fr", "French"), ("es", "Spanish"), ("de", "German")]
N_FORWARD = 3
N_BACKWARD = 2


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "code STRING, name STRING")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_corpus(spark, f"{sf_dir}/documents.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents differ much in length, so they are spread before the split and sentences
    again before they fan out (see forward)."""
    return extract_sentences(spread(corpus(spark, sf_dir), "doc_id"))


def kept_words(words: Column, offset: Column | int, every: int) -> Column:
    """Words but those at positions where (position + offset) is a multiple of ``every``."""
    shift = F.lit(offset) if isinstance(offset, int) else offset
    return F.filter(words, lambda w, i: (i + shift) % every != 0)


def drop_words(text: Column, offset: Column | int, every: int) -> Column:
    """Text without the words at positions where (position + offset) is a multiple of ``every``."""
    return F.array_join(kept_words(words(text), offset, every), " ")


def _forward_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences are cut into words once, before they fan out."""
    asked = spread(sentences(spark, sf_dir), "sent_id").withColumn("_words", words(F.col("sentence")))
    return fan_out(asked, N_FORWARD, "fwd_idx").withColumn("_words", kept_words(F.col("_words"), F.col("fwd_idx"), 5))


def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forward_words(spark, sf_dir)
    return rows.withColumn("fwd_text", F.array_join("_words", " ")).drop("_words")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forward_words(spark, sf_dir).withColumn("fwd_text", F.array_join("_words", " "))
    kept = kept_words(F.col("_words"), F.col("bwd_idx") * 2 + F.col("fwd_idx"), 7)
    return fan_out(rows, N_BACKWARD, "bwd_idx").withColumn("bwd_text", F.array_join(kept, " ")).drop("_words")


def _split(doc_id: Column) -> Column:
    return F.when(doc_id % 2 == 0, "dev").otherwise("devtest")


def _with_nbsp(text: Column) -> Column:
    return F.replace(text, F.lit("la "), F.lit("la\u00a0"))


def _english(text: Column) -> Column:
    return _with_nbsp(drop_words(text, 0, 4))


def parallel_files(
    spark: SparkSession, sf_dir: str, rewrite: Callable[[Column], Column] = _english
) -> tuple[DataFrame, DataFrame]:
    """(target files of all languages, English file): every non-English document is a target
    text, and the English file has a rewrite of every document under the same id."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    tgt = docs.where(F.col("lang") != "en").select(
        "lang",
        F.col("doc_id").alias("id"),
        _split(F.col("doc_id")).alias("split"),
        _with_nbsp(F.col("text")).alias("text"),
    )
    eng = docs.select(
        F.col("doc_id").alias("id"),
        _split(F.col("doc_id")).alias("split"),
        rewrite(F.col("text")).alias("text"),
    )
    return tgt, eng


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ``parallel_files``. Documents are matched first and the matched ones rewritten: no rewrite has a no-break space."""
    tgt, eng = parallel_files(spark, sf_dir, rewrite=lambda text: text)
    return parallel_pairs(tgt, eng).withColumn("text_eng", drop_words(F.col("text_eng"), 0, 4))


def bitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(
        "lang",
        "id",
        F.col("text_eng").alias("sentence_eng"),
        F.col("text_tgt").alias("sentence_tgt"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pairs with stand-in predictions for both directions."""
    return (
        pair_columns(pairs(spark, sf_dir), "lang", "id", "split")
        .withColumn("fwd_pred", drop_words(F.col("tgt"), 1, 5))
        .withColumn("bwd_pred", drop_words(F.col("eng"), 2, 7))
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation input: candidates of each matched pair with one back-translation each. Texts are cut into words before they fan out."""
    matched = pairs(spark, sf_dir).select(
        "lang", "id", F.col("text_tgt").alias("gold"), F.col("text_eng").alias("source")
    )
    asked = spread(matched, "lang", "id").withColumns({"_gold": words(F.col("gold")), "_source": words(F.col("source"))})
    forth, back = kept_words(F.col("_gold"), F.col("fwd_idx"), 5), kept_words(F.col("_source"), F.col("fwd_idx") * 2, 7)
    rows = fan_out(asked, N_FORWARD, "fwd_idx").withColumns({"fwd_text": F.array_join(forth, " "), "bwd_text": F.array_join(back, " ")})
    return rows.drop("_gold", "_source")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations; assistant texts of even ones start with a reasoning block."""
    thinks = (F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0)
    block = F.concat(F.lit("<think>step "), F.col("turn"), F.lit("</think> "))
    return read(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.when(thinks, F.concat(block, F.col("text"))).otherwise(F.col("text")).alias("text"),
    )


def conversation_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON info per conversation; every third one lacks the language name."""
    ids = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    name = F.when(F.col("conv_id") % 3 != 0, "German")
    return ids.select(
        "conv_id",
        F.to_json(F.struct(F.lit("de").alias("target_lang"), name.alias("lang_name"))).alias("info"),
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw completions: a third run on after the stop string, some are empty."""
    n = F.col("doc_id") + F.col("pos") + F.col("fwd_idx")
    return forward(spark, sf_dir).select(
        "sent_id",
        "sentence",
        "fwd_idx",
        F.when(n % 50 == 0, "")
        .when(n % 3 == 0, F.concat(F.lit(" "), F.col("fwd_text"), F.lit(" \nand so on\n")))
        .otherwise(F.col("fwd_text"))
        .alias("text"),
    )


def old_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards and stand-in old log-probabilities over the words of each forward candidate."""
    base = _forward_words(spark, sf_dir).withColumn("_n", F.length(F.array_join("_words", " ")))
    return base.select(
        "sent_id",
        "fwd_idx",
        ((F.col("_n") % 17) / 10).alias("bleu"),
        ((F.col("_n") % 13) / 10).alias("chrf"),
        F.transform("_words", lambda w, i: -(F.length(w) % 7 + 1) / 10 - (i % 3) / 20).alias("old"),
    )


def token_logs(old: DataFrame) -> DataFrame:
    """Rows of ``old_logs`` with the stand-in logs that follow from the old ones; long, so made after rows are exchanged."""
    return old.select(
        "*",
        F.transform("old", lambda o, i: o + ((i % 5) - 2) / 20).alias("policy"),
        F.transform("old", lambda o, i: o - (i % 4) / 40).alias("ref"),
        F.transform("old", lambda o, i: (i >= 2).cast("int")).alias("mask"),
    )
