"""Streams with state and with an end, against the same work as one batch."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from echotrip.operators import head
from echotrip.operators.sentences import extract_sentences, first_sentences
from echotrip.plans import training
from echotrip.streaming import jobs

SENTENCE = "one two three four five six seven eight"


def rollouts(n=9, forward=2, backward=3):
    rng = random.Random(3)
    words = SENTENCE.split()
    cut = lambda: " ".join(w for w in words if rng.random() < 0.8)
    return [(f"s{s}", SENTENCE, f, "x", b, cut()) for s in range(n) for f in range(forward) for b in range(backward)]


def arrive(spark, rows, path):
    spark.createDataFrame(rows, jobs.ROLLOUT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **how):
    query = jobs.stream_advantages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 2, 3, 1, **how)
    query.awaitTermination(240)
    assert query.exception() is None
    return jobs.latest_advantages(spark, str(tmp_path / "out"))


def batch(spark, rows):
    made = training.reward_tables(spark.createDataFrame(rows, jobs.ROLLOUT_SCHEMA))
    backward = sorted(map(tuple, made["backward"].select("sent_id", "fwd_idx", "bwd_idx", "bleu", "chrf", "adv_bleu", "adv_chrf", "group_size").collect()))
    forward = sorted(map(tuple, made["forward"].select("sent_id", "fwd_idx", "bleu", "chrf", "adv_bleu", "adv_chrf", "group_size").collect()))
    return backward, forward


def rows_of(frames):
    return tuple(sorted(tuple(r)[:-1] for r in frame.collect()) for frame in frames)


def test_advantages_come_out_with_the_last_sibling_and_equal_the_batch(spark, tmp_path):
    rows = rollouts()
    # Siblings lie in different files; of the last sentence one is missing.
    for b in (2, 0, 1):
        arrive(spark, [r for r in rows if r[4] == b and (r[0], r[2], b) != ("s8", 1, 1)], str(tmp_path / "in"))
    frames = run(spark, tmp_path)
    whole = [r for r in rows if r[0] != "s8"]
    backward, forward = rows_of(frames)
    expected = batch(spark, [r for r in rows if (r[0], r[2]) != ("s8", 1)])
    assert backward == expected[0]
    assert forward == batch(spark, whole)[1]
    # The stream is started again with the missing sibling: the state had been kept, nothing else is done again.
    arrive(spark, [r for r in rows if (r[0], r[2], r[4]) == ("s8", 1, 1)], str(tmp_path / "in"))
    frames = run(spark, tmp_path)
    assert rows_of(frames) == batch(spark, rows)
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.where("sent_id = 's3'").select("revision").distinct().count() == 1
    assert stored.where("sent_id = 's8' AND direction = 'backward' AND fwd_idx = 0").count() == 3


def test_one_arriving_file_is_scored_by_many_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("string(id) sent_id", "'a b c d e' sentence", "0 fwd_idx", "'x' fwd_text", "0 bwd_idx", "'a b c' bwd_text")
    path, out = str(tmp_path / "in"), tmp_path / "out"
    rows.coalesce(1).write.parquet(path)
    jobs.stream_rewards(spark, path, str(out), str(tmp_path / "offsets")).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 400 and len(list(out.glob("*.parquet"))) > 4


def test_late_and_repeated_siblings(spark, tmp_path):
    rows = rollouts(3)
    arrive(spark, rows, str(tmp_path / "in"))
    run(spark, tmp_path)
    late = [("s1", SENTENCE, 0, "x", 3, "one two three four")]
    arrive(spark, rows[:6] + late, str(tmp_path / "in"))  # the first sentence once more
    assert rows_of(run(spark, tmp_path)) == batch(spark, rows + late)
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.where("sent_id = 's0'").agg(F.max("revision")).first()[0] == 1
    assert stored.where("sent_id = 's1' AND fwd_idx = 0").agg(F.max("revision")).first()[0] == 2
    assert stored.where("sent_id = 's1' AND fwd_idx = 1 AND direction = 'backward'").agg(F.max("revision")).first()[0] == 1


class FakeState:
    def __init__(self, held=None, timed_out=False):
        self.held, self.hasTimedOut, self.removed = held, timed_out, False

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def update(self, held):
        self.held = held

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, ms):
        self.until = ms

    def remove(self):
        self.held, self.removed = None, True


def test_what_is_not_whole_comes_out_when_time_is_up():
    step = jobs._gather(2, 2, 50)
    frame = pd.DataFrame([("s", 0, 0, 10.0, 20.0), ("s", 0, 1, 30.0, 20.0), ("s", 1, 0, 5.0, 6.0)], columns=["sent_id", "fwd_idx", "bwd_idx", "bleu", "chrf"]).assign(arrived_ms=[1000, 1003, 1002])
    state = FakeState()
    first = pd.concat(step(("s",), iter([frame]), state))
    assert set(first.fwd_idx) == {0} and first.complete.all() and set(first.direction) == {"backward"} and state.until == 1053
    assert [round(x, 6) for x in first.adv_bleu] == [-0.707107, 0.707107] and list(first.adv_chrf) == [0.0, 0.0]
    state.hasTimedOut = True
    rest = pd.concat(step(("s",), iter([]), state))
    assert state.removed
    got = {(r.direction, r.fwd_idx): r.complete for r in rest.itertuples()}
    assert got == {("backward", 0): True, ("backward", 1): False, ("forward", 0): False, ("forward", 1): False}
    whole = FakeState(([0, 0, 1, 1], [0, 1, 0, 1], [1.0, 2.0, 3.0, 4.0], [1.0] * 4, 1), timed_out=True)
    assert list(step(("s",), iter([]), whole)) == [] and whole.removed


def corpus(spark, ids):
    text = F.concat(F.lit("Here is the first sentence of document "), "id", F.lit(". And here comes the second one of it."))
    return spark.createDataFrame([(i,) for i in ids], "id long").select(F.col("id").alias("doc_id"), text.alias("text"))


@pytest.mark.parametrize("n", [1, 10, 13, 20, 25])
def test_stream_ends_after_the_first_n(spark, tmp_path, n):
    path = str(tmp_path / "in")
    for k in range(3):
        corpus(spark, range(k * 5, k * 5 + 5)).coalesce(1).write.mode("append").parquet(path)
    if n <= 20:
        # The last file cannot be read: a stream that opened it would fail.
        (tmp_path / "in" / "part-9.parquet").write_bytes(b"no parquet")
    got = jobs.stream_first_sentences(spark, path, n, str(tmp_path / "out"), str(tmp_path / "cp"), 1)
    expected = first_sentences(corpus(spark, range(15)), n).collect()
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(map(tuple, expected)) and len(expected) == n
    again = jobs.stream_first_sentences(spark, path, n, str(tmp_path / "out"), str(tmp_path / "cp"), 1)
    assert again.count() == n


def test_stream_of_the_first_n_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    corpus(spark, range(5)).coalesce(1).write.parquet(path)
    assert jobs.stream_first_sentences(spark, path, 23, out, str(tmp_path / "cp"), 1).count() == 10
    for k in (1, 2):
        corpus(spark, range(k * 5, k * 5 + 5)).coalesce(1).write.mode("append").parquet(path)
    # The cut of the last batch fails half way; the next run does that batch again and nothing else.
    with monkeypatch.context() as broken:
        broken.setattr(jobs, "cut_rows", lambda *a: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            jobs.stream_first_sentences(spark, path, 23, out, str(tmp_path / "cp"), 1)
    got = jobs.stream_first_sentences(spark, path, 23, out, str(tmp_path / "cp"), 1)
    expected = first_sentences(corpus(spark, range(15)), 23).collect()
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(map(tuple, expected))


def test_first_rows_of_any_key(spark, monkeypatch):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 97 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") * 7919 % 3000)).alias("k"),
        (F.col("id") % 5).cast("decimal(9,2)").alias("d"),
        "id",
    )
    monkeypatch.setattr(head, "SAMPLE", 400)
    monkeypatch.setattr(head.key_bound, "__defaults__", (400,))
    for order in (["k", "id"], ["d", "k", "id"], ["id"]):
        for n in (1, 40, 700, 2999, 5000):
            expected = sorted(map(tuple, rows.orderBy(*order).limit(n).collect()), key=str)
            for most in (100_000, 10):
                monkeypatch.setattr(head, "IN_ONE_TASK", most)
                assert sorted(map(tuple, head.first_rows(rows, order, n).collect()), key=str) == expected
    assert head.key_bound(rows, ["k", "id"], 40) is not None and head.key_bound(rows, ["k", "id"], 2999) is None


def test_many_first_rows_stay_where_they_are(spark, plan, monkeypatch):
    monkeypatch.setattr(head, "IN_ONE_TASK", 100)
    cut = head.first_rows(spark.range(5000), ["id"], 2000)
    assert "TakeOrdered" not in plan(cut) and "GlobalLimit" not in plan(cut)
    assert cut.rdd.getNumPartitions() > 1 and cut.count() == 2000


def test_long_first_sentences(spark, monkeypatch):
    monkeypatch.setattr(head, "IN_ONE_TASK", 5)
    docs = corpus(spark, range(40))
    got = first_sentences(docs, 33).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, extract_sentences(docs).orderBy("doc_id", "pos").limit(33).collect()))
