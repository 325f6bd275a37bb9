"""Text clean-up and tokenisation as column expressions (no Python workers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split()/strip() treat as white space, written out
# because the "\s" of other engines is narrower.
WHITESPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same without the space itself.
ODD_WHITESPACE = WHITESPACE.replace(r"\x1c-\x20", r"\x1c-\x1f")

# The same characters as a plain set, for trimming.
WHITESPACE_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

# A sentence ends at . ! or ?, closing quotes or brackets, then white space and an opening
# quote/bracket, capital letter or digit.
SENTENCE_END = r"""([.!?]["')\]]*)""" + WHITESPACE + r"""+(["'(]?[A-Z0-9À-Ý])"""

MARK = "\u0001"
HELD_DOT = "\u0002"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE_CHARS))


def words(text: Column) -> Column:
    """White-space separated words, without empty ones.

    A split at one plain character needs no pattern, which is compiled anew for every text.
    """
    return F.array_remove(F.split(F.regexp_replace(text, ODD_WHITESPACE, " "), " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def squeeze(text: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(text, WHITESPACE, "")


def replace_nbsp(text: Column) -> Column:
    return F.replace(text, F.lit("\u00a0"), F.lit(" "))


def split_sentences(text: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Array of stripped sentences of one text.

    ``abbreviations`` (without the final dot) never end a sentence.
    """
    if abbreviations:
        names = "|".join(a.replace(".", r"\.") for a in abbreviations)
        text = F.regexp_replace(
            text, rf"(^|[^A-Za-z])({names})\.({WHITESPACE})", f"$1$2{HELD_DOT}$3"
        )
    parts = F.split(F.regexp_replace(text, SENTENCE_END, f"$1{MARK}$2"), MARK)
    if abbreviations:
        parts = F.transform(parts, lambda s: F.replace(s, F.lit(HELD_DOT), F.lit(".")))
    return F.transform(parts, strip)


def mark_13a(text: Column) -> Column:
    """Text with white space around every mteval-v13a token (the tokenisation of BLEU)."""
    t = F.rtrim(text, F.lit(WHITESPACE_CHARS))
    t = F.replace(t, F.lit("<skipped>"), F.lit(""))
    t = F.replace(t, F.lit("-\n"), F.lit(""))
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    # Entities, in this order.
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    # The published mteval-v13a patterns. The first class leaves out the space, which
    # the final split removes anyway; \D is several times faster than [^0-9] in the JVM.
    for pattern, repl in (
        (r"([!-&(-+:-@\[-`{-~/])", " $1 "),
        (r"(\D)([.,])", "$1 $2 "),
        (r"([.,])(\D)", " $1 $2"),
        (r"([0-9])(-)", "$1 $2 "),
    ):
        t = F.regexp_replace(t, pattern, repl)
    return t


def tokenize_13a(text: Column) -> Column:
    """mteval-v13a tokens as an array."""
    return words(mark_13a(text))


def peel_punctuation(text: Column) -> Column:
    """Words for chrF++: one trailing ASCII punctuation mark split off, else one leading."""
    # ASCII punctuation.
    punct = r"[!-/:-@\[-`{-~]"

    def peel(w: Column) -> Column:
        size = F.length(w)
        return (
            F.when((size > 1) & w.rlike(punct + "$"), F.array(F.substring(w, F.lit(1), size - 1), F.right(w, F.lit(1))))
            .when((size > 1) & w.rlike("^" + punct), F.array(F.left(w, F.lit(1)), F.substring(w, F.lit(2), size - 1)))
            .otherwise(F.array(w))
        )

    return F.flatten(F.transform(words(text), peel))


def cut_completion(text: Column, stop: str | None = "\n") -> Column:
    """Completion up to the stop string (``None`` keeps all), stripped."""
    return strip(F.substring_index(text, stop, 1) if stop else text)


def visible_answer(text: Column) -> Column:
    """Reply without its reasoning block (all up to the last ``</think>``), stripped."""
    return strip(F.substring_index(text, "</think>", -1))
