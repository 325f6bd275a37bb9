"""The corpus pipeline: documents go through the stages in order, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrip.llm import mixing, near_dups, pieces, quality, repeats
from echotrip.llm.queries import MIX_WEIGHTS, held_out, table
from echotrip.session import stage


# Passages of over 50 words: about the shortest 50 words of the given texts, in bytes.
PASSAGES = repeats.Settings(length=240, reach=112, tile=8)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = quality.train(docs.where(~held_out()), labels)
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of rows of one id the one that is compared; rows without an id stay."""
    single = near_dups.one_per_id(docs)
    kept = near_dups.near_duplicates(single).where("kept").select("doc_id")
    named = single.join(kept, "doc_id", "left_semi")
    return named.select(*docs.columns).union(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of some 50 words; the first copy stays."""
    return repeats.cut_text(docs, settings=PASSAGES).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: target shares of four languages, none of which shrinks."""
    return mixing.repeat(docs, mixing.mix(docs, docs, MIX_WEIGHTS, lossless=True, keyed=True))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    encoded = pieces.encode(docs, pieces.read_model())
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_languages),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


# The classifier and the encoding have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None
