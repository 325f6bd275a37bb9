"""What queries over rollouts leave on disk, and that they give the same rows with less."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from echotrip.operators import rewards
from echotrip.session import shared_folder
from workload.queries import QUERIES


@pytest.fixture
def sf(spark, tmp_path):
    rng = random.Random(9)
    said = lambda: " ".join(rng.choice("one two three four five six seven".split()) for _ in range(rng.randrange(5, 14))).capitalize() + "."
    rows = [(i if i % 7 else None, " ".join(said() for _ in range(4)), "en", "web") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.withColumn("n_chars", F.length("text").cast("long")).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.fixture
def staged(spark):
    """What a test left in the shared folder."""
    folder = Path(shared_folder(spark))
    found = lambda: set(folder.iterdir()) if folder.exists() else set()
    before = found()
    return lambda: {p.name.rsplit("-", 1)[0]: p for p in found() - before}


def test_moments_in_place_are_those_of_the_join(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([0, 1, None]), rng.choice([rng.random() * 100, 50.0, 1e6, None]), rng.random() * 100) for _ in range(200)]
    rows += [("one", 0, 3.0, 4.0), ("same", 0, 5.0, 5.0), ("same", 0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "sent_id string, fwd_idx int, bleu double, chrf double").repartition(5)
    for keys in (["sent_id"], ["sent_id", "fwd_idx"]):
        joined, in_place = (rewards.advantages(df, keys, in_place=how).collect() for how in (False, True))
        rounded = lambda found: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in map(tuple, found) if None not in r)
        assert rounded(joined) == rounded(in_place) and len(joined) == len(in_place) == 203
        exact = lambda found: sorted(map(str, found))
        small = df.where("bleu < 128")
        assert exact(rewards.advantages(small, keys).collect()) == exact(rewards.advantages(small, keys, in_place=True).collect())


@pytest.mark.parametrize("name", ["advantages_bwd", "advantages_fwd"])
def test_advantages_are_exchanged_once_and_not_staged(spark, sf, staged, plan, name):
    found = QUERIES[name](spark, sf)
    text = plan(found)
    assert text.count("Exchange hashpartitioning") == 3 and "Join" not in text  # documents, sentences, scores
    assert found.count() > 0 and not staged()


def test_arriving_rollouts_are_not_exchanged_again(spark, sf, staged):
    found = QUERIES["streamed_rewards"](spark, sf)
    expected = QUERIES["cycle_rewards"](spark, sf)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    arrived = [p.name for p in staged()["arriving"].glob("*.parquet")]
    assert len(arrived) > 4 and all(name.endswith(".zstd.parquet") for name in arrived)
    batches = [p for p in staged()["offsets"].joinpath("commits").iterdir() if p.name.isdigit()]
    assert 1 <= len(batches) <= 2


@pytest.mark.parametrize("name", ["sampled_rollouts", "stored_rollouts"])
def test_only_what_is_read_again_stays(spark, sf, staged, name):
    found = QUERIES[name](spark, sf)
    assert set(staged()) <= {"rollout", "completions"}
    assert found.count() > 0 and not found.where("fwd_text is null or bwd_text is null").count()
