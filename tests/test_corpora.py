import json
import re

import pytest
from pyspark.sql import functions as F

from echotrip.operators import sentences
from echotrip.sources import corpora, languages, results


def test_sentence_extraction(spark):
    text = 'Too short. Here are five plain words. "Next one" has a quote! (And some brackets too, yes.) 3 more words are here? no break after lower case'
    corpus = spark.createDataFrame([(1, text), (2, ""), (3, "w " * 90 + "."), (4, "w " * 90)], "doc_id long, text string")
    got = [(r.sent_id, r.sentence) for r in sentences.extract_sentences(corpus).orderBy("doc_id", "pos").collect()]
    assert got == [
        ("1:1", "Here are five plain words."),
        ("1:2", '"Next one" has a quote!'),
        ("1:3", "(And some brackets too, yes.)"),
        ("1:4", "3 more words are here? no break after lower case"),
    ]


def test_abbreviations_do_not_split(spark):
    corpus = spark.createDataFrame([(1, "I saw Dr. Smith at the station today. He waved at me twice.")], "doc_id long, text string")
    plain = sentences.extract_sentences(corpus, min_words=1).count()
    held = sentences.extract_sentences(corpus, min_words=1, abbreviations=["Dr"]).orderBy("pos").collect()
    assert plain == 3 and [r.sentence for r in held] == ["I saw Dr. Smith at the station today.", "He waved at me twice."]


def test_token_limit_by_pandas_udf(spark):
    import pandas as pd

    @F.pandas_udf("long")
    def letters(s: pd.Series) -> pd.Series:
        return s.str.len()

    corpus = spark.createDataFrame([(1, "One two three four five. Six seven eight nine ten eleven.")], "doc_id long, text string")
    got = sentences.extract_sentences(corpus, max_words=None, token_count=letters, max_tokens=25).collect()
    assert [r.pos for r in got] == [0]


@pytest.mark.parametrize("ids", ["dense", "sparse", "clustered", "negative"])
@pytest.mark.parametrize("n", [1, 700, 10**6])
def test_first_sentences_is_exact(spark, ids, n):
    make = {
        "dense": lambda i: i,
        "sparse": lambda i: (i * 7919 % 3001) * 10**14,
        "clustered": lambda i: i if i < 2900 else 10**17 + i,
        "negative": lambda i: i * i - 10**6,
    }[ids]
    rows = [(make(i), "short. " if i % 3 else f"Doc {i} has a sentence here. And then Another one follows it.") for i in range(3000)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sentences.extract_sentences(corpus).orderBy("doc_id", "pos").limit(n).collect()
    assert sentences.first_sentences(corpus, n).collect() == expected


def test_first_sentences_reads_only_the_head(spark, tmp_path, plan):
    rows = [(i, f"Doc {i} has a sentence here.") for i in range(5000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "c"))
    got = sentences.first_sentences(corpora.read_corpus(spark, str(tmp_path / "c")), 10)
    assert "LessThanOrEqual(doc_id," in plan(got) and got.count() == 10


def test_first_sentences_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sentences.first_sentences(empty, 5).collect() == []


def test_corpus_formats_and_pruning(spark, tmp_path, plan):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "url_id long, body string, extra string")
    df.write.parquet(str(tmp_path / "p"))
    df.write.json(str(tmp_path / "j"))
    for fmt, folder in (("parquet", "p"), ("json", "j")):
        got = corpora.read_corpus(spark, str(tmp_path / folder), fmt, "url_id", "body")
        assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b")]
        assert "extra" not in plan(got)


def test_parallel_files(spark, tmp_path, plan):
    rows = [(l, s, i, f"{l} {s} {i}") for l in ("eng", "fra", "deu") for s in ("dev", "devtest") for i in range(4)]
    rows = [r for r in rows if r[:3] != ("fra", "dev", 2)]
    path = str(tmp_path / "parallel")
    spark.createDataFrame(rows, "lang string, split string, id long, text string").write.partitionBy("lang", "split").parquet(path)
    tgt = corpora.read_parallel(spark, path, ["fra", "deu"], "dev")
    eng = corpora.read_parallel(spark, path, ["eng"], "dev")
    assert re.search(r"PartitionFilters: \[[^\]]*lang", plan(eng))
    pairs = corpora.parallel_pairs(tgt, eng)
    got = sorted((r.lang, r.id, r.text_tgt, r.text_eng) for r in pairs.collect())
    assert len(got) == 7 and got[0] == ("deu", 0, "deu dev 0", "eng dev 0")
    assert corpora.first_pairs(pairs, ["lang", "id"], None).count() == 7
    assert [r.id for r in corpora.first_pairs(pairs, ["lang", "id"], 3).collect()] == [0, 1, 2]
    assert {r.split for r in corpora.read_parallel(spark, path, ["fra"], "test").collect()} == {"devtest"}


def test_bitext(spark, tmp_path):
    path = str(tmp_path / "bitext")
    spark.createDataFrame([(1, "one", "un"), (2, "two", "deux")], "n long, sentence_eng_Latn string, sentence_fra_Latn string").write.parquet(path)
    assert {tuple(r) for r in corpora.read_bitext(spark, path, "fra_Latn").collect()} == {("one", "un"), ("two", "deux")}
    assert corpora.bitext_train(spark.read.parquet(path), ["n"], 1).collect() == [(1, "one")]


def test_split_names(spark):
    row = spark.range(1).select(*[corpora.source_split(s, k) for k in ("parallel", "bitext") for s in ("dev", "test")]).first()
    assert tuple(row) == ("dev", "devtest", "valid", "test")


def test_languages(spark, tmp_path):
    path = tmp_path / "langs.csv"
    path.write_text('code,name\nace_Arab,Acehnese (Jawi)\nnob_Latn,Norwegian Bokmål\n"x_Y","a, b"\n')
    dim = languages.read_languages(spark, str(path))
    assert {r.code: r.name for r in dim.collect()}["x_Y"] == "a, b"
    wanted = spark.createDataFrame([("ace_Arab",), ("zz",), ("zz",), ("aa",)], "code string")
    assert sorted(r.code for r in languages.unknown_languages(wanted, dim).collect()) == ["aa", "zz"]
    with pytest.raises(ValueError, match=r"\['aa', 'zz'\].*ace_Arab"):
        languages.require_languages(wanted, dim)
    languages.require_languages(wanted.limit(1), dim)
    assert languages.hosted_languages(spark).count() == 84


def test_correlation_csv_round_trip(spark, tmp_path):
    schema = results.CORRELATION_SCHEMA
    df = spark.createDataFrame([(0, 0.5, -0.25, None, 1e-12, 0), (1, -0.5, 0.25, 1.0, 0.1, 0)], schema)
    path = str(tmp_path / "fra_metrics.csv")
    results.write_correlation(df, path)
    assert sorted(results.read_correlation(spark, path).collect()) == sorted(df.collect())
    by_lang = str(tmp_path / "all.csv")
    results.write_correlation(df.withColumn("lang", F.lit("fra")), by_lang)
    assert results.read_correlation(spark, by_lang + "/lang=fra").count() == 2


def test_metric_log(spark, tmp_path):
    path = str(tmp_path / "log")
    report = spark.createDataFrame(
        [("fra", "forward", "bleu", 1.5), ("fra", "backward", "chrf", 2.5)],
        "lang string, direction string, metric string, score double",
    )
    results.append_metrics(report, path, 0, "dev")
    results.append_metrics(report.select("metric", "score"), path, 50, "train")
    log = results.read_metrics(spark, path)
    assert log.count() == 4 and log.where("step = 50 AND lang IS NULL AND split = 'train'").count() == 2
    nested = json.loads(results.nested_report(report).first().report)
    assert nested == {"forward": {"bleu": 1.5}, "backward": {"chrf": 2.5}}


@pytest.mark.parametrize("fmt", ["json", "text", "parquet"])
def test_records_are_numbered_in_the_order_of_the_files(spark, tmp_path, fmt):
    texts = [f"record {i} " + "x" * (i * 37 % 200) for i in range(400)]
    for k, (lo, hi) in enumerate(((0, 150), (150, 151), (151, 151), (151, 400))):
        part = spark.createDataFrame([(t,) for t in texts[lo:hi]], "text string").coalesce(1)
        part.write.format(fmt).save(str(tmp_path / f"{k}"))
    paths = str(tmp_path / "*")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    try:
        for size in ("128m", "3k", "700"):  # other cuts of the files, the same numbers
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = corpora.read_corpus(spark, paths, fmt, id_col=None)
            assert rows.columns == ["doc_id", "text"]
            got.append(sorted(map(tuple, rows.collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[0] == got[1] == got[2] == list(enumerate(texts))
    few = corpora.read_corpus(spark, paths, fmt, id_col=None)
    assert sentences.first_sentences(few.withColumn("text", F.concat(F.lit("Here is a whole sentence with "), "text")), 3).count() == 3


def test_a_step_written_twice_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "log")
    report = spark.createDataFrame([("de", "forward", "bleu", 1.0), ("de", "forward", "chrf++", 2.0)], "lang string, direction string, metric string, score double")
    results.append_metrics(report, path, 1)
    results.append_metrics(report, path, 1, split="dev")
    results.append_metrics(report, path, 2, split="dev")
    results.append_metrics(report.withColumn("score", F.col("score") + 10), path, 1, split="dev")
    got = sorted(((r.step, r.split, r.metric, r.score) for r in results.read_metrics(spark, path).collect()), key=str)
    assert got == sorted(
        [(s, p, m, v + more) for s, p, more in ((1, None, 0), (1, "dev", 10), (2, "dev", 0)) for m, v in (("bleu", 1.0), ("chrf++", 2.0))], key=str
    )
    assert results.read_metrics(spark, path).columns == ["step", "split", "lang", "direction", "metric", "score"]
