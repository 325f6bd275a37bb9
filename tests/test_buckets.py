"""State of a stream by buckets of sentences, against the plain definition one sentence at a time."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from echotrip.functions import exact
from echotrip.operators.rewards import STD_FLOOR
from echotrip.streaming import jobs

N_FORWARD, N_BACKWARD, PATIENCE = 2, 2, 50


class State:
    """A bucket's state as the engine keeps it."""

    def __init__(self):
        self.held, self.until, self.hasTimedOut, self.watermark = None, None, False, 0

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def update(self, held):
        self.held = held

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, ms):
        assert ms >= self.watermark
        self.until = ms

    def remove(self):
        self.held = None


class Plain:
    """Sentences in dictionaries."""

    def __init__(self):
        self.held, self.revision, self.until = {}, {}, {}

    def group(self, name, s, keys, scores, complete):
        columns = []
        for metric in zip(*scores):
            average, deviation = exact.moments(list(metric))
            columns.append([0.0 if min(metric) == max(metric) else (v - average) / max(deviation, STD_FLOOR) for v in metric])
        return [(name, s, *key, *score, *adv, len(keys), self.revision[s], complete) for key, score, adv in zip(keys, scores, zip(*columns))]

    def rows(self, s, out, over):
        if not out:
            return []
        held, rows = self.held[s], []
        whole = {f for f in held if len(held[f]) >= N_BACKWARD}
        self.revision[s] += 1
        for f in sorted(out):
            order = sorted(held[f])
            rows += self.group("backward", s, [(f, b) for b in order], [held[f][b] for b in order], not over or f in whole)
        if over or len(whole) >= N_FORWARD and whole == set(held):
            means = [tuple(round(exact.moments(list(m))[0], 9) for m in zip(*held[f].values())) for f in sorted(held)]
            rows += self.group("forward", s, [(f, None) for f in sorted(held)], means, not over)
        return rows

    def call(self, arrived, watermark):
        rows = []
        for s in dict.fromkeys(r[0] for r in arrived):
            changed, is_new = set(), s not in self.held
            held = self.held.setdefault(s, {})
            self.revision.setdefault(s, 0)
            for _, f, b, *score, _ in (r for r in arrived if r[0] == s):
                if held.setdefault(f, {}).get(b) != tuple(score):
                    held[f][b] = tuple(score)
                    changed.add(f)
            rows += self.rows(s, {f for f in changed if len(held[f]) >= N_BACKWARD}, False)
            if changed or is_new:
                self.until[s] = max(watermark, *[r[-1] for r in arrived if r[0] == s]) + PATIENCE
        for s in [s for s in self.held if self.until[s] < watermark and s not in {r[0] for r in arrived}]:
            n_whole = sum(len(g) >= N_BACKWARD for g in self.held[s].values())
            rows += self.rows(s, set(self.held[s]) if self.revision[s] == 0 or n_whole < N_FORWARD else set(), True)
            del self.held[s], self.revision[s], self.until[s]
        return rows


def test_a_bucket_does_what_its_sentences_would_do_alone():
    rng = random.Random(5)
    for trial in range(40):
        step, state, plain = jobs._gather_many(N_FORWARD, N_BACKWARD, PATIENCE, 6), State(), Plain()
        for now in range(0, 400, 20):
            state.watermark = max(0, now - PATIENCE)
            arrived = [
                (rng.choice(["s0", "s1", "s2", "s3", None]), rng.randrange(3), rng.randrange(3), rng.choice([0.0, 12.345678, 99.999999]), round(rng.random() * 100, 6), now + rng.randrange(20))
                for _ in range(rng.choice([0, 1, 4, 9]))
            ]
            frame = pd.DataFrame(arrived, columns=["sent_id", "fwd_idx", "bwd_idx", "bleu", "chrf", "arrived_ms"])
            state.hasTimedOut = not arrived
            if arrived or state.exists and state.until < state.watermark:
                got = [tuple(None if x is pd.NA else x for x in r) for f in step((0,), iter([frame] if arrived else []), state) for r in f.itertuples(index=False, name=None)]
            else:
                got = []
            assert sorted(got, key=str) == sorted(plain.call(arrived, state.watermark), key=str), (trial, now)
            assert state.exists == bool(plain.held) and (not plain.held or state.until == min(plain.until.values()))


def test_moments_of_many_groups_are_those_of_each():
    rng = np.random.default_rng(2)
    for kind in range(4):
        sizes = rng.integers(1, [3, 6, 40, 5][kind], 200)
        starts = np.cumsum(sizes) - sizes
        values = rng.random(sizes.sum()) * [100, 100, 100, 1e6][kind]
        mean, deviation = exact.group_moments(values, starts)
        for i, (start, n) in enumerate(zip(starts, sizes)):
            one = exact.moments(values[start : start + n].tolist())
            assert mean[i] == one[0] and (np.isnan(deviation[i]) if n == 1 else deviation[i] == one[1])


def test_state_has_a_row_for_a_bucket_not_for_a_sentence(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 3)
    rows = spark.range(600).selectExpr("string(id div 2) sent_id", "'a b c d e' sentence", "0 fwd_idx", "'x' fwd_text", "int(id % 2) bwd_idx", "'a b c' bwd_text")
    rows.where("bwd_idx = 0").write.parquet(str(tmp_path / "in"))
    for more in (False, True):
        if more:
            rows.where("bwd_idx = 1").write.mode("append").parquet(str(tmp_path / "in"))
        query = jobs.stream_advantages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 1, 2)
        query.awaitTermination(120)
        assert query.exception() is None and query.recentProgress[0].stateOperators[0].numRowsTotal <= 3
    backward, forward = jobs.latest_advantages(spark, str(tmp_path / "out"))
    assert (backward.count(), forward.count()) == (600, 300) and forward.where(F.col("complete")).count() == 300
