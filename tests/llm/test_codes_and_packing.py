"""Centroid clusters, vector codes and packing against plain definitions."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from echotrip.llm import clusters, dictionaries, packing, queries, token_counts, vector_codes

SHAPE = "vec_id bigint, embedding array<double>, label int, cluster string, code string, width int"


def frame(spark, rows):
    """``rows``: (vec_id, embedding, label); other columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, v, k, "x", "y", -1) for i, v, k in rows], SHAPE).repartition(5)


def nearest(x, entries):
    far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in entries]
    return far.index(min(far)), min(far)


def moved(points, entries):
    out = []
    near = [nearest(p, entries)[0] for p in points]
    for j, entry in enumerate(entries):
        mine = [p for p, k in zip(points, near) if k == j]
        out.append([sum(column) // len(mine) for column in zip(*mine)] if mine else entry)
    return out


def integers(v, scale):
    return [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in v]


def clusters_by_hand(rows, s):
    kept = [(i, integers(v, s.scale)) for i, v, _ in rows if v and len(v) == s.width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{s.seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[: s.k]]
    for _ in range(s.rounds):
        centroids = moved([v for _, v in kept], centroids)
    return sorted(((i, *nearest(v, centroids)) for i, v in kept), key=str), centroids


def odd_vectors(width, seed, n=300):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [rng.gauss(m, 0.2) for m in rng.choice(middles)], i % 4) for i in range(n)]
    rows += [(n + i, rows[7][1], None) for i in range(n // 3)]  # a third are equal
    rows += [(3, rows[3][1], 1), (3, rows[5][1], 1), (None, rows[8][1], 2), (n * 2, [0.0] * width, 2), (n * 2 + 1, [-1e-320] * width, 3)]
    rows += [(n * 3, None, 1), (n * 3 + 1, [None] + [0.1] * (width - 1), 1), (n * 3 + 2, [float("nan")] * width, 1)]
    return rows + [(n * 3 + 3, [float("-inf")] * width, 1), (n * 3 + 4, [0.1] * (width + 1), 1), (n * 3 + 5, [], 1)]


def test_clusters(spark):
    s = clusters.Settings(width=12, rounds=4)
    rows = odd_vectors(12, 1)
    found = clusters.cluster_vectors(frame(spark, rows), settings=s)
    expected, centroids = clusters_by_hand(rows, s)
    assert found.centroids == centroids
    assert sorted(map(tuple, found.assigned.collect()), key=str) == expected
    sums = [sum(d for _, k, d in expected if k == j) for j in range(s.k)]
    assert found.inertias == sums
    shown = clusters.described(found).collect()
    assert len(shown) == len(expected) and {r.inertia for r in shown} == {sum(sums)}
    assert all(r.cluster_inertia == sums[r.cluster] and [int(x) for x in r.centroid] == centroids[r.cluster] for r in shown)


def test_clusters_beyond_64_bits(spark):
    s = clusters.Settings(width=3, k=3, rounds=3)
    rows = [(i, [x, -x, 0.5], 0) for i, x in enumerate([1.5, 2.5, 1e7, 1.1e7, 1e12, 1e200, 1.01e200, -1e306, 3.0, 1e12])]
    found = clusters.cluster_vectors(frame(spark, rows), settings=s)
    expected, centroids = clusters_by_hand(rows, s)
    assert found.centroids == centroids
    longest = dictionaries.LONGEST
    assert sorted(map(tuple, found.assigned.collect()), key=str) == sorted(((i, k, min(d, longest)) for i, k, d in expected), key=str)
    assert clusters.described(found).count() == len(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * 64, None) for i in range(n)]
    found = clusters.cluster_vectors(frame(spark, rows))
    assert sorted(map(tuple, clusters.described(found).select("vec_id", "cluster_inertia", "inertia").collect())) == [(i, 0, 0) for i in range(n)]
    codes = vector_codes.compress(frame(spark, rows), keep=("label",))
    assert sorted(map(tuple, codes.coded.collect())) == [(i, None, 64, bytes([i] * 8), 0) for i in range(n)]
    assert vector_codes.decoded(codes).count() == n


def codes_by_hand(rows, s):
    out, books = [], {}
    fine = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and len(v) % s.parts == 0]
    for width in {len(v) for _, v, _ in fine}:
        mine = [(i, integers(v, s.scale), k) for i, v, k in fine if len(v) == width]
        first = sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[: s.entries]
        size = width // s.parts
        cut = lambda v, p: v[p * size : (p + 1) * size]  # noqa: B023, E731
        book = [[cut(v, p) for _, v, _ in first] for p in range(s.parts)]
        for _ in range(s.rounds):
            book = [moved([cut(v, p) for _, v, _ in mine], entries) for p, entries in enumerate(book)]
        books[width] = book
        for i, v, k in mine:
            near = [nearest(cut(v, p), book[p]) for p in range(s.parts)]
            out.append((i, k, width, bytes(j for j, _ in near), min(sum(d for _, d in near), dictionaries.LONGEST)))
    return sorted(out, key=str), books


def test_vector_codes(spark):
    s = vector_codes.Settings(rounds=3)
    rows = odd_vectors(16, 2, n=150) + [(5000 + i, [i / 9, 0.3, -i / 5, 1.0, 1e200 if i == 4 else 0.0, 1.0, 2.0, i * 1e9], 0) for i in range(30)]
    codes = vector_codes.compress(frame(spark, rows), keep=("label",), settings=s)
    expected, books = codes_by_hand(rows, s)
    assert {w: b.tolist() for w, b in codes.books.items()} == books
    assert sorted(map(tuple, codes.coded.collect()), key=str) == expected
    near = vector_codes.decoded(codes, s.scale).where("width = 16 and vec_id < 150").collect()
    vectors = {i: v for i, v, _ in rows if i not in (3, None)}
    for r in near:
        if r.vec_id != 3:
            assert sum((a - b) ** 2 for a, b in zip(r.approximation, vectors[r.vec_id])) <= r.error / s.scale**2 * 1.1 + 0.01


def test_whole_tables_give_the_contracts_digests(spark, tmp_path):
    rows = odd_vectors(64, 3, n=60)
    spark.createDataFrame([(i, v, k) for i, v, k in rows], "vec_id bigint, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    s = clusters.Settings()
    expected, centroids = clusters_by_hand(rows, s)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sums = [sum(d for _, k, d in expected if k == j) for j in range(s.k)]
    got = sorted(map(tuple, queries.op11_clusters(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, k, d, sums[k], sum(sums), digests[k]) for i, k, d in expected), key=str)
    codes, books = codes_by_hand(rows, vector_codes.Settings())
    digests = {w: hashlib.sha256(",".join(str(x) for part in b for e in part for x in e).encode()).hexdigest() for w, b in books.items()}
    errors = {k: sum(e for _, other, _, _, e in codes if other == k) for _, k, _, _, _ in codes}
    got = sorted(map(tuple, queries.op12_vector_codes(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, c.hex(), e, errors[k], digests[w]) for i, k, w, c, e in codes), key=str)


def test_limbs_hold_any_integer():
    total = np.array([[0, -1, 2**40, -(2**90) + 5, 7]], object)
    back = [0] * 5
    for cell, limb, part in zip(*dictionaries._limbs(total)):
        back[cell] += part << (dictionaries.LIMB * limb)
    assert back == total.ravel().tolist()


def held(rows, texts, length=2048):
    """Checks of all pieces: every id once and right, sequences without gaps, none padded."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = sorted((i if i is not None else -1, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in texts)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id if r.doc_id is not None else -1, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    got = []
    for i, pieces in by_doc.items():
        # Rows of one id are told apart by order of start: each begins at 0.
        pieces = sorted(pieces, key=lambda r: r.start)
        copies = sum(r.start == 0 for r in pieces)
        if copies > 1:
            assert sum(r.length for r in pieces) == sum(len(ids) for j, ids in wanted if j == i)
            got += [(j, ids) for j, ids in wanted if j == i]
            continue
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist()
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert {r.doc_tokens for r in pieces} == {len(ids)}
        got.append((i, ids))
    assert sorted(got) == wanted
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([0] + [r.length for r in pieces]).tolist()
        assert [r.offset for r in pieces] == ends[:-1] and min(r.length for r in pieces) > 0
        assert ends[-1] <= length and ends[-1] & (ends[-1] - 1) == 0 and {r.capacity for r in pieces} == {ends[-1]}
    return by_sequence


def texts_of_all_lengths(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta7", "«gamma»", "\n\n", "  ", "delta-", "Ωmega", "x" * 30, "don't", "<|endoftext|>", "\t", "東京"])
    texts = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 5, 40, 300, 900])))) for i in range(120)]
    texts += [(200, None), (201, ""), (None, "no id at all"), (202, texts[5][1]), (203, "long word " * 9000), (204, "y" * 20_000), (205, " " * 3000 + "\n")]
    return texts + [(206, "same row"), (206, "same row")]


def test_packing(spark):
    texts = texts_of_all_lengths(4)
    docs = spark.createDataFrame([(i, t, 9, "s", 0.5) for i, t in texts], "doc_id bigint, text string, start int, ids string, cost double").repartition(3)
    packed = packing.pack(docs, settings=packing.Settings(block=20_000, slice=700))
    rows = packed.collect()
    sequences = held(rows, texts)
    whole = packing.sequences(packed).collect()
    assert {r.sequence_id: (r.n_pieces, r.n_tokens, bytes(r.ids)) for r in whole} == {
        s: (len(p), sum(r.length for r in p), b"".join(bytes(r.ids) for r in p)) for s, p in sequences.items()
    }


def test_packing_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(none).collect() == []
    blank = spark.createDataFrame([(i, None if i % 2 else "") for i in range(5)], "doc_id bigint, text string").coalesce(1)
    rows = packing.pack(blank).collect()
    assert sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in rows) == [(i, 0, 1, 1) for i in range(5)]
    assert len({r.sequence_id for r in rows}) == 2
    keyless = packing.pack(blank, keys=()).columns
    assert keyless == ["start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost", "capacity"]


def test_packing_query(spark, tmp_path):
    texts = texts_of_all_lengths(6)
    spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_packing(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])


def test_lowest_cost_sequence_takes_the_next_document():
    sizes = np.array([900, 800, 300, 200, 100, 300], np.int64)
    capacities = np.array([1300, 1300], np.int64)
    found = packing.assign(sizes, capacities, hidden=16)
    assert [(p, s) for p, _, _, s, _ in found] == [(0, 0), (1, 1), (2, 1), (5, 0), (3, 1), (4, 0)]
    cut = packing.assign(np.array([700, 700, 600], np.int64), np.array([1024, 976], np.int64), 16)
    assert cut == [(0, 0, 700, 0, 0), (1, 0, 700, 1, 0), (2, 0, 324, 0, 700), (2, 324, 276, 1, 700)]


def test_costs_of_sequences_are_even():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1500, 2000)
    capacities = packing.room(int(sizes.sum()), 2048)
    assert capacities.sum() == sizes.sum()
    cost = np.zeros(len(capacities))
    for _, _, n, sequence, _ in packing.assign(sizes, capacities, 1024):
        cost[sequence] += packing.cost_of(n, 1024)
    whole = cost[capacities == 2048]
    assert whole.std() / whole.mean() < 0.05
    pieces = len(packing.assign(sizes, capacities, 1024))
    assert pieces < 2000 + len(capacities)


def test_long_white_space_encodes_like_the_library():
    encoder = packing.Encoder(packing.Settings())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 600_000 + "a", "\n \t" * 200_000, "ab 1\n" * 100_000):
        assert encoder.document(text).tolist() == library.encode(text, add_special_tokens=False).ids + [1]


def test_counts_of_odd_texts_are_the_librarys():
    count = token_counts.counter(token_counts.VOCABULARY, token_counts.PATTERN, token_counts.SLOW_VOCABULARY)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    for text in ("", "a", " " * 1_000_000, "x\n" + "\n" * 700_000 + "y", "<|endoftext|> plain", "don't\t \u3000 «é» 12 345", "z" * 100_000):
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids)
