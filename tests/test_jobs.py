"""Prompts, transcripts, candidates, numbering, whole plans, streaming."""

import json
import math

import pytest
from pyspark.sql import functions as F

from echotrip.operators import candidates, numbering, prompts, reports, transcripts
from echotrip.operators.head import first_rows
from echotrip.operators.sentences import extract_sentences
from echotrip.plans import correlation, evaluation, hosted, training
from echotrip.session import shared_folder
from echotrip.streaming import jobs


def translator(limit=64):
    """Test translator: drops a word that depends on the seed when sampling."""

    def factory():
        def translate(asked, seeds, options):
            assert len(asked) == len(seeds) <= limit
            out = []
            for prompt, seed in zip(asked, seeds):
                words = prompt.split("\n")[-2].split(": ", 1)[1].split()
                if options["do_sample"]:
                    del words[seed % len(words)]
                out.append("  " + " ".join(words) + "\nmore text\n")
            return out

        return translate

    return factory


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(f"s{i}", "deu_Latn", "German", f"one two three four five six number {i} here") for i in range(20)]
    return spark.createDataFrame(rows, "sent_id string, lang string, lang_name string, sentence string")


def test_prompts(spark):
    df = spark.createDataFrame([("Hi {there}.", "German", "facebook/nllb-200"), ("Hi.", "German", "NLLB")], "s string, l string, m string")
    s, name, model = F.col("s"), F.col("l"), F.col("m")
    row = df.select(
        prompts.forward_prompt(s, name), prompts.backward_prompt(s, name),
        prompts.forward_prompt(s, name, "instruct"), prompts.backward_prompt(s, name, "instruct"),
        prompts.forward_prompt(s, name, model=model),
    ).collect()
    assert row[0][0] == "Translate the following English sentence into German.\n\nEnglish: Hi {there}.\nGerman:"
    assert row[0][1] == "Translate the following German sentence into English.\n\nGerman: Hi {there}.\nEnglish:"
    only = "Output only the translated text and no other text."
    assert row[0][2] == f"Translate the following English sentence into German. {only}\n\nEnglish: Hi {{there}}."
    assert row[0][3] == f"Translate the following German sentence into English. {only}\n\nGerman: Hi {{there}}."
    assert row[0][4] == "Hi {there}." and row[1][4].startswith("Translate")  # the test is case-sensitive


def test_chat_rows(spark, asked):
    row = prompts.chat_rows_monolingual(asked, "sent_id").orderBy("sent_id").first()
    assert [m.asDict() for m in row.prompt][0]["role"] == "user" and row.prompt[0].content.endswith(row.answer)
    assert json.loads(row.info) == {"target_lang": "deu_Latn", "lang_name": "German"}


def test_transcripts(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "<think>a</think>b</think>\n Hallo "), (1, 2, "user", "thanks"),
        (2, 0, "user", "q"), (3, 0, "assistant", "first"), (3, 1, "assistant", "<think>unfinished"),
    ]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.answer for r in transcripts.final_answers(chats).collect()}
    assert got == {1: "Hallo", 2: None, 3: "<think>unfinished"}
    info = spark.createDataFrame([(1, '{"lang_name": "German"}'), (3, "{}")], "conv_id long, info string")
    added = {r.conv_id: r for r in transcripts.next_turn(chats, info).collect()}
    assert added.keys() == {1, 3} and added[1].turn == 3 and added[1].text.endswith("German: Hallo")
    assert "the target language sentence" in added[3].text
    assert transcripts.extend(chats).count() == 8


def test_rollout(spark, asked):
    rolled = candidates.rollout(asked, translator(), n_forward=3, n_backward=2, seed=4)
    rows = rolled.collect()
    assert len(rows) == 20 * 3 * 2
    assert all("more" not in r.bwd_text and r.fwd_text == r.fwd_text.strip() for r in rows)
    assert any(len({r.fwd_text for r in rows if r.sent_id == f"s{i}"}) > 1 for i in range(20))
    again = candidates.rollout(asked.repartition(5), translator(), n_forward=3, n_backward=2, seed=4)
    assert sorted(rows) == sorted(again.collect())  # seeds depend on keys only
    other = candidates.rollout(asked, translator(), n_forward=3, n_backward=2, seed=5)
    assert sorted(rows) != sorted(other.collect())


def test_greedy_backward_has_one_candidate(spark, asked):
    rows = candidates.rollout(asked, translator(), n_forward=2, greedy_backward=True).collect()
    assert len(rows) == 40 and {r.bwd_idx for r in rows} == {0}
    assert all(r.bwd_text == r.fwd_text for r in rows)


def test_translator_batches_and_stop(spark, asked):
    done = candidates.greedy(
        asked.withColumn("p", prompts.forward_prompt(F.col("sentence"), F.col("lang_name"))),
        translator(limit=2), "p", "out", ["sent_id"], stop=None, batch_size=2,
    )
    assert all(r.out == f"{r.sentence}\nmore text" for r in done.collect())


def test_regroup_and_flatten(spark):
    flat = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("b", 0, "z"), ("b", 2, "w")], "k string, i int, t string")
    lists = candidates.regroup(flat, ["k"], "i", "t", 3, "ts")
    assert {r.k: r.ts for r in lists.collect()} == {"a": ["x", "y"], "b": ["z", "w"]}
    assert candidates.flatten(lists, ["k"], "ts", "i", "t").count() == 4
    holes = spark.createDataFrame([("a", 0, "x"), ("a", 1, None), ("a", 2, "y")], "k string, i int, t string")
    assert candidates.regroup(holes, ["k"], "i", "t", 3, "ts").first().ts == ["x", None, "y"]
    for wrong in ([("a", 3, "x")], [("a", 0, "x"), ("a", 0, "y")], [("a", None, "x")], [("a", -1, "x")]):
        with pytest.raises(Exception, match="outside 0 to 2 or not unique"):
            candidates.regroup(spark.createDataFrame(wrong, "k string, i int, t string"), ["k"], "i", "t", 3, "ts").collect()
    tree = spark.createDataFrame(
        [("s", j, f"f{j}", k, f"b{j}{k}") for j in range(2) for k in range(3)],
        "sent_id string, fwd_idx int, fwd_text string, bwd_idx int, bwd_text string",
    )
    row = candidates.regroup_tree(tree, 2, 3).first()
    assert row.fwd_texts == ["f0", "f1"] and row.bwd_texts == [["b00", "b01", "b02"], ["b10", "b11", "b12"]]
    with pytest.raises(Exception, match="outside the fan-out or not unique"):
        candidates.regroup_tree(tree.union(tree.limit(1)), 2, 3).collect()
    with pytest.raises(Exception, match="outside the fan-out or not unique"):
        candidates.regroup_tree(tree, 2, 2).collect()


def test_index_rows(spark):
    df = spark.range(2000).select(
        (F.col("id") * 7919 % 2000).alias("k"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g")
    )
    assert all(r.k == r.row_index for r in numbering.index_rows(df, ["k"]).collect())
    within = numbering.index_rows(df, ["k"], "n", within=("g",)).collect()
    for group in "ab":
        mine = sorted((r for r in within if r.g == group), key=lambda r: r.k)
        assert [r.n for r in mine] == list(range(len(mine)))


def test_index_rows_needs_no_global_window(spark, plan):
    text = plan(numbering.index_rows(spark.range(100), ["id"]))
    assert "BroadcastHashJoin" in text and "rangepartitioning" not in text  # staged before numbering


def test_sentence_index_is_dense(spark):
    df = spark.createDataFrame([(d, p, f) for d, p in ((5, 0), (5, 3), (90, 1)) for f in range(3)], "doc_id long, pos int, f int")
    got = numbering.sentence_index(df, ["doc_id", "pos"]).collect()
    assert {(r.doc_id, r.pos): r.sent_idx for r in got} == {(5, 0): 0, (5, 3): 1, (90, 1): 2}


def test_epoch_batches(spark):
    ids = spark.range(103).select(F.col("id").cast("string").alias("sent_id"))
    rows = numbering.epoch_batches(ids, "sent_id", 2, 10, seed=1).collect()
    for epoch in (0, 1):
        mine = sorted((r for r in rows if r.epoch == epoch), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(103))
        assert {r.sent_id for r in mine} == {str(i) for i in range(103)}
        assert [r.batch for r in mine] == [i // 10 for i in range(103)]
    orders = [[r.sent_id for r in sorted(rows, key=lambda r: r.position) if r.epoch == e] for e in (0, 1)]
    assert orders[0] != orders[1]


@pytest.mark.parametrize("n", [1, 3, 8, 9])
def test_shards(spark, n):
    rows = spark.range(n).select(F.col("id").alias("position"), (F.col("id") * 10).alias("x"))
    padded = numbering.shards(rows, 4).collect()
    sizes = {s: sum(r.shard == s for r in padded) for s in range(4)}
    assert set(sizes.values()) == {math.ceil(n / 4)}
    order = [r.x // 10 for r in sorted(padded, key=lambda r: r.position)]
    assert order == [i % n for i in range(math.ceil(n / 4) * 4)]
    assert numbering.shards(rows, 4, pad=False).count() == n


def test_preview_limits_before_the_exchange(spark, plan):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    shown = reports.preview(df, ["g"], ["id"], 5)
    assert "WindowGroupLimit" in plan(shown) and shown.count() == 10


def test_training_plan(spark, asked):
    tables = training.run(asked, translator(), "chrf", n_forward=3, n_backward=2)
    forward, backward = tables["forward"].collect(), tables["backward"].collect()
    assert len(forward) == 60 and len(backward) == 120 and {r.group_size for r in backward} == {2}
    assert all(r.advantage == r.adv_chrf for r in forward)
    table = reports.example_table(tables["rollouts"], tables["forward"], ["sent_id"])
    assert table.columns == ["original_english", "fwd_idx", "predicted_target", "bwd_idx", "final_predicted_english", "bleu", "chrf"]
    assert table.count() == 15 and {r.fwd_idx for r in table.collect()} == set(range(5))


def test_evaluation_plan(spark):
    rows = [("deu_Latn", "German", i, "dev", f"eins zwei drei {i} fünf", f"one two three {i} five") for i in range(6)]
    pairs = spark.createDataFrame(rows, "lang string, lang_name string, id long, split string, text_tgt string, text_eng string")
    frames, report = evaluation.run(pairs, translator())
    assert frames.count() == 12 and report.count() == 4
    # The test translator echoes the source, so predictions are judged against the other side.
    row = frames.where("direction = 'forward' AND source LIKE '%3%'").first()
    assert row.target_pred == row.source and row.target_gold.startswith("eins")


def test_correlation_plan(spark):
    rows = []
    for s in range(12):
        gold = f"the quick brown fox {s} jumps over the lazy dog again"
        for k in range(4):
            cut = " ".join(w for i, w in enumerate(gold.split()) if (i + s) % (k + 2) or s == 0)
            rows.append((s, k, gold, gold, cut, cut if k % 2 else cut + " x"))
    df = spark.createDataFrame(rows, "id long, fwd_idx int, gold string, source string, fwd_text string, bwd_text string")
    results = correlation.run(df, ["id"])
    table = results["table"].collect()
    assert len(table) == 48 and {r.sent_idx for r in table} == set(range(12))
    assert all(r.bleu is None for r in table if r.id == 0)  # equal candidates
    fit = results["chrf_regression"].first()
    assert fit.n == 44 and 0.5 < fit.slope <= 1.01 and fit.p < 0.01
    assert results["bleu_mixed"].first().n_groups == 11 and results["bleu_line"].count() == 200


def test_sampled_candidates_carry_gold_and_source(spark, asked):
    pairs = asked.select("sent_id", "lang", "lang_name", F.col("sentence").alias("text_eng"), F.upper("sentence").alias("text_tgt"))
    rows = correlation.sample_candidates(pairs, translator(), 2).collect()
    assert len(rows) == 40 and all(r.gold == r.source.upper() and r.bwd_text == r.fwd_text for r in rows)


def test_hosted_rows_and_rewards(spark):
    dim = spark.createDataFrame([("deu_Latn", "German")], "code string, name string")
    corpus = spark.createDataFrame([(i, f"This is sentence number {i} of it.") for i in range(9)], "doc_id long, text string")
    rows = hosted.monolingual_rows(corpus, dim, "deu_Latn", 4).collect()
    assert [r.sent_id for r in rows] == ["0:0", "1:0", "2:0", "3:0"]
    with pytest.raises(ValueError, match="Unknown target language"):
        hosted.monolingual_rows(corpus, dim, "xx", 4)
    pairs = spark.createDataFrame([("deu_Latn", 1, "eins", "one")], "lang string, id long, text_tgt string, text_eng string")
    for direction, asked, answer in (("forward", "English: one", "eins"), ("backward", "German: eins", "one")):
        row = hosted.parallel_rows(pairs, dim, direction).first()
        assert row.prompt[0].content.endswith(asked) and row.answer == answer
    chats = spark.createDataFrame([(1, 0, "assistant", "<think>x</think>abc def"), (2, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    answers = spark.createDataFrame([(1, "abc def"), (2, "x")], "conv_id long, expected string")
    got = hosted.score_transcripts(chats, answers, "chrf", scale=0.01).collect()
    assert sorted((r.conv_id, r.reward, r.answered) for r in got) == [(1, 1.0, True), (2, 0.0, False)]
    assert hosted.score_transcripts(chats, answers.where("conv_id = 2")).where("conv_id = 1").first().reward is None


def test_first_rows(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), (F.col("id") % 3).alias("j"))
    for order in (["k"], ["j", "k"]):
        assert first_rows(df, order, 37).collect() == df.orderBy(*order).limit(37).collect()
    named = df.withColumn("k", F.col("k").cast("string"))
    assert first_rows(named, ["k"], 3).count() == 3
    assert first_rows(df.where("false"), ["k"], 3).count() == 0
    some = spark.createDataFrame([(None,), (1,), (2,), (-(2**62),), (2**62,)], "k long")
    assert [r.k for r in first_rows(some, ["k"], 3).collect()] == [None, -(2**62), 1]


def test_streamed_sentences_equal_batch(spark, tmp_path):
    corpus = str(tmp_path / "corpus")
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("Here is the first sentence of document "), "id", F.lit(". And here comes the second one.")).alias("text"),
    )
    for start in (0, 20):
        docs.where(f"doc_id >= {start} AND doc_id < {start + 20}").coalesce(2).write.mode("append").parquet(corpus)
        query = jobs.stream_sentences(spark, corpus, str(tmp_path / "out"), str(tmp_path / "cp"), files_per_batch=1)
        query.awaitTermination(120)
        assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id", "pos").collect()
    assert got == extract_sentences(docs).orderBy("doc_id", "pos").collect() and len(got) == 80


def test_streamed_rewards_equal_batch(spark, tmp_path):
    rows = [
        (f"s{s}", "one two three four five six", f, "x", b, " ".join("one two three four five six".split()[: 2 + (s + f + b) % 5]))
        for s in range(8) for f in range(2) for b in range(3)
    ]
    rolled = spark.createDataFrame(rows, jobs.ROLLOUT_SCHEMA)
    # A sentence's candidates are scattered over files and batches.
    for b in range(3):
        rolled.where(f"bwd_idx = {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = jobs.stream_rewards(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 1)
    query.awaitTermination(120)
    backward, forward = jobs.reward_state(spark, str(tmp_path / "out"))
    batch = training.reward_tables(rolled)
    for streamed, name, keys in ((backward, "backward", ["sent_id", "fwd_idx", "bwd_idx"]), (forward, "forward", ["sent_id", "fwd_idx"])):
        assert streamed.orderBy(*keys).collect() == batch[name].drop("advantage").orderBy(*keys).collect()


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, master, **conf):
        self.sparkContext, self.conf = FakeContext(master), {k.replace("_", "."): v for k, v in conf.items()}


def test_shared_folder_is_the_one_the_session_names(spark):
    named = FakeSession("yarn", spark_checkpoint_dir="hdfs:///shared/")
    assert shared_folder(named) == "hdfs:///shared"
    local = FakeSession("local[2]")
    assert shared_folder(local) == shared_folder(local) != ""
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession("spark://host:7077"))
    setting = spark.conf.get("spark.checkpoint.dir", None)
    assert setting is None or shared_folder(spark) == setting.rstrip("/")
