"""Abbreviations learnt from a corpus without labels, for the sentence split.

A type (lower-case word) is an abbreviation if its occurrences with a final dot are far likelier under "nearly always dotted" than under
the corpus' own rate of dots: a log-likelihood ratio, weighted by length, inner dots and occurrences without a dot, as in Kiss and
Strunk (2006). Words that begin sentences are found by a second ratio, over the words after marks that end no abbreviation; an
abbreviation that mostly stands before one of them, capitalised, or at the end of a text ends sentences itself and is not learnt.

The corpus is read once and shrinks to counts by word, dot and following word, so nothing grows with the texts but the vocabulary.

Defined results: null and empty texts count nothing; words without a letter, or with signs inside, are no types; an ellipsis is no
dot; a corpus without dots, or an empty one, gives no rows; repeated documents count as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrip.functions.text import words
from echotrip.session import stage

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
OPENING = r"""^["'(\[]*"""
# Opening signs, the word (dots inside), its final dot, closing signs.
TYPE = OPENING + rf"""([{LETTER}](?:[{LETTER}.]*[{LETTER}])?)(\.?)[!?"')\],;:]*$"""
MARK = r"""[.!?]["')\]]*$"""
LOWER = OPENING + "[a-zß-öø-ÿ]"


@dataclass(frozen=True)
class Settings:
    score: float = 0.3  # of an abbreviation, at least
    starter: float = 30.0  # log-likelihood ratio of a word that begins sentences, at least
    ends: float = 0.5  # share of dots that end a sentence, below


def count_words(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """``(form, dotted, follower, kind, n)``: occurrences of words by final dot and, after a mark, by the type that follows.

    ``kind`` tells how a following word begins: lower, upper, other (no type), none (end of the text); without a mark it is null.
    """
    listed = corpus.select(words(F.col(text_col)).alias("words"))
    pairs = listed.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.slice("words", F.lit(2), F.size("words")).alias("next"))))
    pairs = pairs.toDF("word", "next")
    after = F.lower(F.regexp_extract("next", TYPE, 1))
    marked = F.col("word").rlike(MARK)
    kind = (
        F.when(~marked, F.lit(None))
        .when(F.col("next").isNull(), "none")
        .when(after == "", "other")
        .when(F.col("next").rlike(LOWER), "lower")
        .otherwise("upper")
    )
    form = F.regexp_extract("word", TYPE, 1)
    seen = pairs.select(
        F.when(form != "", form).alias("form"),
        ((form != "") & (F.regexp_extract("word", TYPE, 2) == ".")).alias("dotted"),
        F.when(kind.isin("lower", "upper"), after).alias("follower"),
        kind.alias("kind"),
    )
    seen = seen.where(F.col("form").isNotNull() | F.col("kind").isNotNull())
    return seen.groupBy("form", "dotted", "follower", "kind").agg(F.count("*").alias("n"))


def _likelihood(hits: Column, trials: Column, chance: Column) -> Column:
    """Log-likelihood of ``hits`` in ``trials``; 0 times the logarithm of 0 is 0."""
    misses = trials - hits
    won = F.when(hits > 0, hits * F.ln(chance)).otherwise(0.0)
    return won + F.when(misses > 0, misses * F.ln(1 - chance)).otherwise(0.0)


def learn(corpus: DataFrame, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """A row per type that occurs with a final dot.

    ``type, forms`` (as written before a dot, sorted), ``n_dot, n_plain, n_lower`` (dots before a lower-case word), ``n_ends`` (dots before a
    capitalised word that begins sentences, or at the end of a text), ``score, learned``.
    """
    s = settings
    counts = stage(count_words(corpus, text_col).withColumn("type", F.lower("form")), "words")
    some = F.col("n")
    types = counts.where("type is not null").groupBy("type").agg(
        F.sum(F.when(F.col("dotted"), some).otherwise(0)).alias("n_dot"),
        F.sum(F.when(F.col("dotted"), 0).otherwise(some)).alias("n_plain"),
        F.sum(F.when(F.col("dotted") & (F.col("kind") == "lower"), some).otherwise(0)).alias("n_lower"),
        F.sort_array(F.collect_set(F.when(F.col("dotted"), F.col("form")))).alias("forms"),
    )
    types = stage(types, "types")
    dotted, plain = F.col("n_dot"), F.col("n_plain")
    n_all, dots = types.agg(F.sum(dotted + plain), F.sum(dotted)).first()
    rate = min(max(dots or 0, 1) / (n_all or 1), 0.99999)
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    ratio = 2 * (dotted * F.ln(F.lit(0.99) / F.lit(rate)) + plain * F.ln(F.lit(0.01) / F.lit(1 - rate)))
    inner = F.length("type") - letters + 1
    score = ratio * F.exp(-letters) * inner * F.pow(letters.cast("double"), -plain)
    scored = stage(types.where(dotted > 0).select("type", "forms", "n_dot", "n_plain", "n_lower", score.alias("score")), "scored")

    # Words after marks that end no abbreviation.
    short = scored.where(F.col("score") >= s.score).select("type", F.lit(True).alias("dotted"))
    breaks = counts.where("follower is not null").join(short, ["type", "dotted"], "left_anti")
    begun = stage(breaks.groupBy(F.col("follower").alias("type")).agg(F.sum("n").alias("k")), "begun")
    n_breaks = begun.agg(F.sum("k")).first()[0] or 1
    both = begun.join(types.select("type", (dotted + plain).alias("n")), "type")
    k, n, b, total = F.col("k"), F.col("n"), F.lit(n_breaks), F.lit(n_all or 1)
    apart = _likelihood(k, b, k / b) + _likelihood(n - k, total - b, (n - k) / F.greatest(total - b, F.lit(1)))
    together = _likelihood(k, b, n / total) + _likelihood(n - k, total - b, n / total)
    starts = both.where((2 * (apart - together) >= s.starter) & (k * total > n * b)).select(F.col("type").alias("follower"))

    ended = counts.where("dotted and kind = 'upper'").join(starts, "follower", "left_semi").select("type", "n")
    ended = ended.union(counts.where("dotted and kind = 'none'").select("type", "n")).groupBy("type").agg(F.sum("n").alias("n_ends"))
    done = scored.join(ended, "type", "left").withColumn("n_ends", F.coalesce("n_ends", F.lit(0)))
    learnt = (F.col("score") >= s.score) & (F.col("n_ends") < s.ends * F.col("n_dot"))
    return done.select("type", "forms", "n_dot", "n_plain", "n_lower", "n_ends", "score", learnt.alias("learned"))


def most_frequent(learnt: DataFrame, most: int = 1000) -> list[str]:
    """Forms of the ``most`` frequent learnt types (by dots, then type), for ``extract_sentences(abbreviations=...)``, whose pattern holds them."""
    top = learnt.where("learned").orderBy(F.desc("n_dot"), "type").limit(most)
    return sorted({form for row in top.select("forms").collect() for form in row.forms})
