"""Stored completions and batches by length."""

import os
import random

import pytest
from pyspark.sql import functions as F

from echotrip.operators import batches, candidates


def counting(log, fail_after=None):
    """Test translator that notes every prompt it is asked, and may give up after some."""

    def factory():
        def translate(asked, seeds, options):
            for prompt, seed in zip(asked, seeds):
                if fail_after is not None and len(os.listdir(log)) >= fail_after:
                    raise RuntimeError("the machine is gone")
                with open(f"{log}/{random.randrange(1 << 60)}", "w") as note:
                    note.write(f"{prompt}|{seed if options['do_sample'] else ''}")
            return [f"{p[::-1]} {s if options['do_sample'] else ''}\nrest" for p, s in zip(asked, seeds)]

        return translate

    return factory


def asked(log):
    return sorted(open(f"{log}/{name}").read() for name in os.listdir(log))


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log"), str(tmp_path / "store")


def prompts(spark, n=60, different=20):
    return spark.createDataFrame([(i, f"prompt {i % different}") for i in range(n)], "id long, p string").repartition(3)


def test_equal_greedy_prompts_are_asked_once_and_never_again(spark, folders):
    log, store = folders
    df = prompts(spark)
    plain = sorted(map(tuple, candidates.greedy(df, counting(log), "p", "out", ["id"]).collect()))
    assert len(asked(log)) == 60
    first = candidates.greedy(df, counting(log), "p", "out", ["id"], store=store, rounds=3)
    assert first.columns == ["id", "p", "out"] and sorted(map(tuple, first.collect())) == plain
    assert len(asked(log)) == 80
    more = prompts(spark, 80, 40)
    again = candidates.greedy(more, counting(log), "p", "out", ["id"], store=store).collect()
    assert len(asked(log)) == 100 and {r.p: r.out for r in again} == {f"prompt {i}": f"{i} tpmorp"[::1] if i < 10 else f"{str(i)[::-1]} tpmorp" for i in range(40)}
    # Another model, or other options, is another request.
    candidates.greedy(df, counting(log), "p", "out", ["id"], store=store, model_name="other").count()
    candidates.greedy(df, counting(log), "p", "out", ["id"], store=store, max_new_tokens=7).count()
    assert len(asked(log)) == 140


def test_samples_differ_by_their_seed_and_are_kept(spark, folders):
    log, store = folders
    df = prompts(spark, 12, 4)
    one = sorted(map(tuple, candidates.sample(df, counting(log), "p", "out", 2, "k", ["id"], store=store, rounds=2).collect()))
    assert len(asked(log)) == 24 and len({r[-1] for r in one}) == 24
    assert sorted(map(tuple, candidates.sample(df, counting(log), "p", "out", 2, "k", ["id"], store=store).collect())) == one
    assert len(asked(log)) == 24


def test_a_killed_run_goes_on_where_it_was(spark, folders):
    log, store = folders
    df = prompts(spark, 40, 40)
    with pytest.raises(Exception, match="the machine is gone"):
        candidates.greedy(df, counting(log, fail_after=25), "p", "out", ["id"], store=store, rounds=8)
    kept = {r.completion for r in spark.read.parquet(store).collect()}
    assert 0 < len(kept) < 40
    before = len(asked(log))
    got = candidates.greedy(df, counting(log), "p", "out", ["id"], store=store, rounds=8).collect()
    assert len(asked(log)) - before == 40 - len(kept)
    assert {r.p: r.out for r in got} == {r.p: r.p[::-1] for r in got} and len(got) == 40


def test_rollout_with_a_store(spark, folders):
    log, store = folders
    sentences = spark.createDataFrame([(f"s{i}", "de", "German", "the same sentence") for i in range(6)], "sent_id string, lang string, lang_name string, sentence string")
    how = dict(n_forward=2, greedy_backward=True, store=store, rounds=2)
    one = sorted(map(tuple, candidates.rollout(sentences, counting(log), **how).collect()))
    n = len(asked(log))
    assert len(one) == 12 and sorted(map(tuple, candidates.rollout(sentences, counting(log), **how).collect())) == one and len(asked(log)) == n


def test_batches_keep_to_their_budget():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.choice([0, 1, 5, 30, 200, 999]) for _ in range(rng.randrange(80))]
        plan = batches.plan(lengths, 400, 16)
        assert sorted(i for rows in plan for i in rows) == list(range(len(lengths)))
        for rows in plan:
            assert len(rows) <= 16 and (len(rows) == 1 or batches.padded(lengths, [rows]) <= 400)


def test_same_completions_with_less_padding(spark, folders):
    log, _ = folders
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(["w"] * rng.randrange(1, 120))) for i in range(500)], "id long, p string").repartition(2)
    seen = []

    def factory():
        def translate(asked, seeds, options):
            lengths = batches.count_words(asked)
            assert len(asked) == 1 or len(asked) * max(lengths) <= 600
            return [f"{len(p)}-{s}" for p, s in zip(asked, seeds)]

        return translate

    by_budget = candidates.complete(df, factory, "p", "out", ["id"], token_budget=600)
    fixed = candidates.complete(df, lambda: lambda asked, seeds, options: [f"{len(p)}-{s}" for p, s in zip(asked, seeds)], "p", "out", ["id"])
    assert sorted(map(tuple, by_budget.collect())) == sorted(map(tuple, fixed.collect())) and not seen
    report = batches.padding_report(df, "p", 600).first()
    assert report.n_prompts == 500 and report.n_tokens == df.agg(F.sum(F.size(F.split("p", " ")))).first()[0]
    assert report.largest <= 600 and report.padding_share < 0.1 < 0.4 < report.fixed_share
    assert batches.padding_report(df.where("false"), "p", 600).first().n_prompts == 0


def test_digests_are_exchanged_as_bytes_and_stored_as_digits(spark, folders, plan):
    log, store = folders
    got = candidates.greedy(prompts(spark), counting(log), "p", "out", ["id"], store=store)
    assert got.count() == 60 and {len(r.key) for r in spark.read.parquet(store).collect()} == {64}
    assert "unhex" in plan(got) and spark.read.parquet(store).where("key = lower(key)").count() == 20
