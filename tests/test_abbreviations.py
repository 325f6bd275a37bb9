"""Abbreviations learnt from the given texts against a planted list, and odd corpora."""

import random

import pyarrow.parquet as pq

from echotrip.operators import abbreviations
from echotrip.operators.sentences import extract_sentences

PLANTED = ["bzw", "Prof", "z.B", "ca", "Nr", "sq"]


def planted_texts(rng):
    """The given texts with the planted abbreviations, dotted, inside their sentences (before names and before small words)."""
    out = []
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist():
        words = (text or "").split(" ")
        placed = []
        for word, after in zip(words, words[1:] + [""]):
            placed.append(word)
            if word[-1:].isalpha() and after[:1].islower() and rng.random() < 0.05:
                name = rng.choice(PLANTED)
                placed.append(name + ".")
                if name == "Prof":
                    placed.append(rng.choice(["Qwilm", "Zuvrax", "Jorvik", "Xylan"]))
        out.append(" ".join(placed))
    return out


def test_planted_abbreviations_are_learnt(spark):
    texts = planted_texts(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    rows = {r.type: r for r in abbreviations.learn(docs).collect()}
    learnt = {t for t, r in rows.items() if r.learned}
    wanted = {name.lower() for name in PLANTED}
    assert wanted <= learnt
    # Of all types with a dot hardly any other: words of repeated passages that end sentences only.
    assert len(learnt - wanted) <= 0.01 * len(rows)
    assert all(rows[t].score <= 0 for t in ("the", "of", "de"))
    names = abbreviations.most_frequent(abbreviations.learn(docs))
    assert set(PLANTED) <= set(names)
    assert len(abbreviations.most_frequent(abbreviations.learn(docs), most=2)) == 2
    # Sentences are no longer cut before the names.
    keep = dict(min_words=1, max_words=None)
    cut = [r.sentence for r in extract_sentences(docs, **keep).collect()]
    whole = [r.sentence for r in extract_sentences(docs, abbreviations=names, **keep).collect()]
    assert sum(x.endswith("Prof.") for x in cut) > 50
    assert not any(x.endswith(" Prof.") for x in whole)


def test_an_abbreviation_before_starters_ends_sentences(spark):
    """``xy.`` is always dotted, but always before a word that begins sentences; ``uv.`` is not."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(300):
        body = [word() for _ in range(6)]
        texts.append(f"The {' '.join(body)} {word()}. The {body[0]} uv. {word()} xy. The {word()}. The {word()} end")
    rows = {r.type: r for r in abbreviations.learn(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert rows["xy"].score > 0.3 and rows["xy"].n_ends == rows["xy"].n_dot == 300 and not rows["xy"].learned
    assert rows["uv"].learned and rows["uv"].n_lower == 300 and rows["uv"].forms == ["uv"]


def test_odd_corpora(spark):
    rows = [(1, None, 3, "x"), (2, "", 3, "x"), (3, " \n\t", 3, "x"), (4, "no dots at all", 3, "x"), (5, "12. 3.5 ... !? a+b.", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint, type string")
    assert abbreviations.learn(docs).collect() == []
    assert abbreviations.learn(docs.limit(0)).collect() == []
    one = docs.limit(0).union(spark.createDataFrame([(1, 'He said "U.S. (Ltd.)," then ended etc.', 3, "x")], docs.schema))
    got = {r.type: r for r in abbreviations.learn(one).collect()}
    assert set(got) == {"u.s", "ltd", "etc"}
    assert got["u.s"].forms == ["U.S"] and got["etc"].n_ends == 1 and got["ltd"].n_lower == 0  # a comma follows
    assert abbreviations.learn(spark.createDataFrame([("a. b. c.",)] * 2, "text string")).count() == 3


def test_counts_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(t,) for t in planted_texts(random.Random(1))], "text string")
    first, second = (sorted(abbreviations.learn(docs.repartition(n)).collect()) for n in (1, 7))
    assert first == second
