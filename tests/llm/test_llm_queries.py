"""Registered queries with SQL twins on the smallest tables, and the pipeline against plain definitions."""

import itertools

import check_oracle
import pytest
import sentencepiece

import corpus_pipeline
from echotrip.llm import pieces
from echotrip.llm.sql import ORACLE
from test_dups import shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    ok, note = check_oracle.compare(spark, check_oracle.connect(SF), SF, name)
    assert ok, note


def test_all_are_registered():
    names = {n.split("_")[0] for n in check_oracle.entry.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in check_oracle.entry.queries()


def test_pipeline(spark, tmp_path):
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    shape = docs.dtypes
    for at, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, SF).write.parquet(f"{tmp_path}/{at}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{at}")
        if at < 4:
            assert docs.dtypes == shape
        rows, old = docs.collect(), before.collect()
        if at == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            left = {r.doc_id for r in rows}
            assert sum(q == 1 and i not in left for i, q in labels.items()) <= 1
            assert sum(q == 0 and i in left for i, q in labels.items()) <= 1
        if at == 1:
            sets = {r.doc_id: shingles(r.text) for r in old}
            near = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
            left = {r.doc_id for r in rows}
            assert not any(near(a, b) for a, b in itertools.combinations(sorted(left), 2))
            assert all(any(near(a, b) for b in sets if b < a) for a in set(sets) - left)
        if at == 2:
            texts = {r.doc_id: r.text.encode() for r in old}
            seen, covered, n = {}, {}, corpus_pipeline.PASSAGES.length
            for i in sorted(texts):
                flags = bytearray(len(texts[i]))
                for p in range(len(flags) - n + 1):
                    if seen.setdefault(texts[i][p : p + n], (i, p)) != (i, p):
                        flags[p : p + n] = b"\1" * n
                covered[i] = bytes(b for b, f in zip(texts[i], flags) if not f).decode("utf-8", "ignore")
            assert {r.doc_id: r.text for r in rows} == covered
            assert all(r.n_chars == len(r.text) for r in rows)
        if at == 3:
            assert {r.doc_id for r in rows} == {r.doc_id for r in old}
        if at == 4:
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            texts = {r.doc_id: r.text for r in old}
            assert len(rows) == len(old) and all(r.ids == library.encode(texts[r.doc_id]) for r in rows)
