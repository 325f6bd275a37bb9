"""Near duplicates, repeated passages and near vectors against plain definitions."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from echotrip.llm import near_dups, repeats, vector_dups
from echotrip.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def family(seed, n, size, edits):
    """A base text, copies with random edits, and texts that share only a long passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(size)] = word()
        out.append(" ".join(copy))
    passage = base[: int(size * 0.6)]
    return out + [" ".join(passage + [word() for _ in range(int(size * 0.4))]) for _ in range(n // 2)]


def test_near_duplicates(spark):
    texts = family(1, 60, 80, 8) + family(2, 30, 30, 3) + family(3, 10, 400, 20)
    texts += [None, "", " \n\t", "one", "ONE", "one two", "x" * 30_000, "a\x0bb c d e\x85f", texts[0].upper(), texts[0], texts[5]]
    rows = [(1000 - i, t, "x", i, 0.5) for i, t in enumerate(texts)] + [(1000, texts[0], "again", 0, 0.1), (None, texts[0], "y", 1, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string, part int, band double").repartition(5)
    got = {r.doc_id: r for r in near_dups.near_duplicates(docs).collect()}
    sets = {1000 - i: shingles(t) for i, t in enumerate(texts)}
    ids = sorted(sets)
    links = [
        (a, b)
        for x, a in enumerate(ids)
        for b in ids[x + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    assert len(links) > 250
    expected = reachable(ids, links)
    assert set(got) == set(ids)
    assert {i: r.component_id for i, r in got.items()} == expected
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == expected[i]) for i, r in got.items())


def test_last_round_alone_finds_all_links(spark):
    # One word is one shingle. Of each family, a and b share 90 of 100 words, each of which other, longer texts hold outside their rarest ones.
    bags = []
    for k in range(12):
        word = lambda kind, n: [f"{kind}{k}x{i}" for i in range(n)]  # noqa: B023, E731
        few, some, many = word("few", 8), word("some", 8), word("many", 74)
        bags += [word("a", 10) + few + some + many, word("b", 10) + few + some + many]
        for x, shared in (("p", few + some + many), ("q", some + many), ("r", many)):
            bags += [word(x, 200) + shared, word(x, 199) + shared]
    ids = range(len(bags))
    sets = [set(bag) for bag in bags]
    links = [(i, j) for i in ids for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert len(links) == 48
    docs = spark.createDataFrame([(i, " ".join(bag)) for i, bag in enumerate(bags)], "doc_id bigint, text string")
    got = near_dups.near_duplicates(docs, settings=near_dups.Settings(words=1, star_rounds=0)).collect()
    assert {r.doc_id: r.component_id for r in got} == reachable(ids, links)


def test_rows_of_one_id_count_once(spark):
    words = lambda kind, n: " ".join(f"{kind}{i}" for i in range(n))
    rows = [(1, words("m", 40), "x"), (2, words("m", 40), "x"), (2, words("a", 30), "x"), (2, None, "x"), (3, words("a", 30), "x")]
    rows += [(4, None, "x"), (4, None, "w"), (5, words("b", 9), "z"), (5, words("b", 9), "y"), (6, words("m", 40), "x"), (None, "n", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = sorted(tuple(r) for r in near_dups.near_duplicates(docs).collect())
    assert got == [(1, 36, 1, True), (2, 26, 2, True), (3, 26, 2, False), (4, 0, 4, True), (5, 5, 5, True), (6, 36, 1, False)]
    stays = [(1, words("m", 40), "x"), (2, words("a", 30), "x"), (4, None, "w"), (5, words("b", 9), "y"), (None, "n", "x")]
    left = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted(stays, key=str)


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_dups.near_duplicates(none).collect() == []
    blank = spark.createDataFrame([(3, None), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, near_dups.near_duplicates(blank).collect())) == [(2, 0, 2, True), (3, 0, 3, True)]


def test_pruning_keeps_what_is_likely():
    s = near_dups.Settings()
    least = near_dups.fewest_matches(s)
    assert least == sorted(least) and least[-1] < 0.75 * s.entries
    # A pair at the threshold is given up with a chance that stays near the chosen one.
    lost = sum(math.comb(128, k) * 0.75**k * 0.25 ** (128 - k) for k in range(least[-1]))
    assert lost < 1e-5


def test_components(spark):
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(40)]
    links = path + [(100, 200 + i) for i in range(60)] + [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(40)]
    links += [(7, 7), (900, 900), (3, 2), (None, 4)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    links = [x for x in links if x[0] is not None]
    got = {r.id: r.component_id for r in components(frame).collect()}
    assert got == reachable({x for pair in links for x in pair}, links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def cut_by_hand(rows, length, keep):
    """rows: (id, bytes); which bytes go."""
    seen = {}
    places = sorted({(i, d) for i, d in rows})
    for i, d in places:
        for p in range(len(d) - length + 1):
            seen.setdefault(d[p : p + length], []).append((i, p))
    twice = {(i, d) for i, d in rows if rows.count((i, d)) > 1}
    gone = {}
    for i, d in places:
        flags = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            where = seen[d[p : p + length]]
            hit = len(where) > 1 or (i, d) in twice if keep == "none" else where[0] != (i, p)
            if hit:
                flags[p : p + length] = True
        gone[i, d] = flags
    return gone


@pytest.mark.parametrize("keep", ["first", "none"])
def test_repeats(spark, keep):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdé fgh\n") for _ in range(n))
    shared, other = text(150), text(90)
    texts = [text(200) + shared + text(50), shared + text(100), text(30) + shared[20:140] + text(30) + other, other + text(10) + other]
    texts += [shared, shared, "ab" * 200, "a" * 300, None, "", "short", texts[0], text(63), shared[:63], other[:70] + shared[70:]]
    texts += [text(20) + shared[:100] + text(20) for _ in range(40)] + [text(400) for _ in range(5)]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    rows.append(rows[2])
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, tag int, start int").repartition(4)
    settings = repeats.Settings(length=64, reach=24)
    got = repeats.remove_repeats(docs, keep=keep, settings=settings).collect()
    plain = [(i, (t or "").encode()) for i, t in rows]
    gone = cut_by_hand(plain, 64, keep)
    expected = []
    for i, d in plain:
        flags = gone[i, d]
        kept = bytes(np.frombuffer(d, np.uint8)[~flags])
        spans = int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())
        expected.append((i, len(d), int(flags.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(expected)
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in got)
    cut = repeats.cut_text(docs, keep=keep, settings=settings)
    assert cut.columns == docs.columns
    by_hand = sorted((i, bytes(np.frombuffer(d, np.uint8)[~gone[i, d]]).decode("utf-8", "ignore")) for i, d in plain)
    assert sorted((r.doc_id, r.text or "") for r in cut.collect()) == by_hand


def test_pipeline_cuts_passages_of_over_50_words(spark):
    rng = random.Random(12)
    words = "time people way water word number part sound place year work back thing name sentence man line boy farm end".split()
    words += [w + "s" for w in words] + ["a", "of", "the", "and", "to", "in", "because", "through", "different", "following"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [say(n) for n in range(51, 81)]
    assert min(len(p) for p in passages) >= corpus_pipeline.PASSAGES.length
    rows = [(10 * k + j, f"{say(60)} {j} {p} {k} {say(60)}") for j in range(6) for k, p in enumerate(passages)]
    clean = {10_000 + i: say(300) for i in range(40)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [*rows, *clean.items()]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs.repartition(4), "").collect()}
    for k, p in enumerate(passages):
        assert [p in left[10 * k + j] for j in range(6)] == [True] + [False] * 5
    assert all(left[i] == t for i, t in clean.items())


@pytest.mark.parametrize("keep", ["first", "none"])
def test_repeats_in_windows_of_long_texts(spark, keep, monkeypatch):
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(700)
    long = text(1900) + shared + text(800) + shared[100:500] + text(300)
    rows = [(1, long), (2, text(37) + long), (3, shared), (4, long[1000:3000]), (5, text(3000)), (6, "ab" * 2000)]
    monkeypatch.setattr(repeats, "CHUNK", 500)
    settings = repeats.Settings(length=64, reach=24)
    runs = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], names=["id", "tag", "text"])
    cut = pa.Table.from_batches(repeats._runs(settings)(iter([runs]))).to_pylist()
    for i, t in rows:  # every start lies in one run
        covered = sorted(x for r in cut if r["id"] == i for x in range(r["start"], r["start"] + r["extra"] + 1))
        assert covered == list(range(len(t) - 63))
    one = [dict(id=1, tag=0, text=long, kinds=[{k: r[k] for k in ("start", "extra", "lead", "core")} for r in cut if r["id"] == 1])]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("extra", pa.int32()), ("lead", pa.int32()), ("core", pa.int64())]))
    opened = pa.RecordBatch.from_pylist(one, pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("text", pa.string()), ("kinds", kind)]))
    tiles = pa.Table.from_batches(repeats._tiles(settings)(iter([opened]))).to_pylist()
    starts = sorted(x for r in tiles for x in range(r["start"], r["start"] + r["extra"] + 1))
    assert starts == list(range(len(long) - 63))
    ranks = {r["start"] + k: v for r in tiles for k, v in enumerate(np.frombuffer(r["ranks"], np.int64).tolist())}
    place = long.index(shared)
    assert ranks[place + 100] == ranks[long.rindex(shared[100:500])] and len(set(ranks.values())) < len(ranks)


def test_repeats_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.remove_repeats(none).collect() == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(none, keep="last")


def vectors(seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((300, 20))
    near = base[:40].repeat(6, axis=0) + rng.standard_normal((240, 20)) * 0.25
    crowd = np.ones(20) + rng.standard_normal((120, 20)) * 0.1
    return np.concatenate([base, near, crowd, crowd[:10], 3 * base[:5]])


def test_near_vectors(spark):
    x = vectors(4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 20, [1.0] * 19 + [None], [1.0] * 19 + [math.nan], [math.inf] + [1.0] * 19, [1.0] * 5, [2.0] * 5]
    rows += [(10_000 + i, v) for i, v in enumerate(odd)] + [rows[3], (None, [1.0] * 20)]
    docs = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id bigint, embedding array<double>, id int, keys string")
    settings = vector_dups.Settings(block=16, recall=0.9999, group=12)
    got = {r.vec_id: r for r in vector_dups.near_vectors(docs.repartition(3), settings=settings).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    links = [(int(a), int(b)) for a, b in np.argwhere(close)] + [(10_006, 10_007)]
    expected = reachable([*range(len(x)), *range(10_000, 10_008)], links)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.995 * close.sum() <= found <= close.sum()
    assert all(got[i].n_links <= close[i].sum() for i in range(len(x)))
    assert {i: r.component_id for i, r in got.items()} == expected
    assert [got[10_000 + i].n_links for i in range(8)] == [0, 0, 0, 0, 0, 0, 1, 1]
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert vector_dups.near_vectors(docs.limit(0)).collect() == []


def test_near_vectors_of_any_size_and_crowds_of_copies(spark):
    rng = np.random.default_rng(9)
    one, other = rng.standard_normal((2, 32))
    near = one + rng.standard_normal(32) * 0.02
    rows = [(5, one * 1e200), (6, near * 1e-200), (7, one * 5e-320 * 1e3), (8, other * 1e300), (9, other * 1e-300), (10, other)]
    rows += [(20_000 + i, other) for i in range(4000)] + [(1, near), (2, near), (90_000, rng.standard_normal(32))]
    rows += [(90_001, np.zeros(32)), (90_002, np.zeros(32)), (90_003, np.full(32, np.nan)), (90_004, np.full(32, np.nan))]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dups.near_vectors(frame, settings=vector_dups.Settings(block=64)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (4, 1) for i in (1, 2, 5, 6, 7))
    assert all(got[i] == (4002, 8) for i in (8, 9, 10, *range(20_000, 24_000)))
    assert all(got[i] == (0, i) for i in range(90_000, 90_005))


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.divmod(np.arange(3600), 60)
    exact, sums, outside = (x[a] * x[b]).sum(axis=1), 0, 0
    for seed in range(60):
        turned, code, factor = vector_dups.encode(x, 128, seed)
        plane, step, low = vector_dups.planes(turned, seed)
        guess = vector_dups.estimates(code[a], factor[a], plane[b], step[b], low[b], 128)
        outside += (np.abs(guess - exact) > vector_dups.slack(factor[a], step[b], 128, 4.0)).sum()
        sums = sums + guess
    assert np.abs(sums / 60 - exact).mean() < 0.02
    assert outside < 1e-3 * 60 * 3600


def test_recall_on_the_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = frame.toPandas()
    x = np.stack(table.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = int((x @ x.T >= 0.9).sum()) - len(x)
    found = sum(r.n_links for r in vector_dups.near_vectors(frame).collect())
    assert 0.9 * links <= found <= links
