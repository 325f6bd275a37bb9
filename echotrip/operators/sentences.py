"""Sentence extraction and the first-N slice of a corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrip.functions import text
from echotrip.operators.head import cut_rows, prefix_bound

# Words a sentence needs, and the word bound standing in for 128 tokens.
MIN_WORDS = 5
MAX_WORDS = 90


def extract_sentences(
    corpus: DataFrame,
    min_words: int = MIN_WORDS,
    max_words: int | None = MAX_WORDS,
    token_count: Callable[[Column], Column] | None = None,
    max_tokens: int | None = None,
    abbreviations: Sequence[str] = (),
) -> DataFrame:
    """``(doc_id, pos, sent_id, sentence, n_words)`` of all sentences of usable length.

    ``min_words <= words < max_words``; with ``token_count`` (a column builder, for example a
    pandas UDF around a tokenizer) also ``token_count < max_tokens``. ``pos`` counts the sentences
    of a document before filtering. Map-only, so it works on a stream as well.
    """
    # Split, count and filter inside the array: each sentence is counted once, and only the kept
    # ones become rows.
    stripped = F.transform(
        text.split_sentences(F.col("text"), abbreviations),
        lambda s, i: F.struct(i.alias("pos"), s.alias("sentence")),
    )
    counted = F.transform(
        stripped,
        lambda s: F.struct(
            s["pos"].alias("pos"),
            s["sentence"].alias("sentence"),
            text.word_count(s["sentence"]).alias("n_words"),
        ),
    )

    def usable(s: Column) -> Column:
        long_enough = s["n_words"] >= min_words
        return long_enough if max_words is None else long_enough & (s["n_words"] < max_words)

    kept = corpus.select("doc_id", F.inline(F.filter(counted, usable)))
    if token_count is not None:
        kept = kept.where(token_count(F.col("sentence")) < max_tokens)
    return kept.select(
        "doc_id",
        "pos",
        F.concat_ws(":", F.col("doc_id"), F.col("pos")).alias("sent_id"),
        "sentence",
        "n_words",
    )


def first_sentences(corpus: DataFrame, n: int, **extract) -> DataFrame:
    """First ``n`` sentences in stream order (doc_id, pos), exactly.

    Like an iterator that stops early, only the head of the corpus is split: documents up to an id
    bound, which grows until the head holds ``n`` sentences. The bound is a pushed-down filter, so
    later files and row groups are skipped when the corpus is stored in id order.
    """
    ids = corpus.select("doc_id")
    top = ids.agg(F.max("doc_id")).first()[0]
    wanted = n
    while top is not None:
        bound = prefix_bound(ids, "doc_id", wanted)
        head = corpus.where(F.col("doc_id").isNull() | (F.col("doc_id") <= bound))
        if bound >= top or extract_sentences(head, **extract).count() >= n:
            corpus = head
            break
        wanted *= 4
    return cut_rows(extract_sentences(corpus, **extract), ["doc_id", "pos"], n)
