"""Moments from whole numbers: right, and the same bits in any order."""

import math
import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from echotrip.functions import exact
from echotrip.operators import rewards


def groups(seed):
    rng = random.Random(seed)
    out = {
        "even": [rng.uniform(0, 100) for _ in range(2000)],
        "close": [50 + rng.uniform(0, 1e-9) for _ in range(300)],
        "closer": [73.1 + k * 2**-44 for k in range(40)],
        "equal": [33.333333333333336] * 17,
        "one": [12.5],
        "signs": [rng.gauss(0, 1) for _ in range(500)],
        "small": [rng.uniform(0, 1e-6) for _ in range(50)],
        "ends": [0.0, 100.0] * 50,
    }
    return {k: v for k, v in out.items()}


def of(spark, rows, parts):
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    sums = df.groupBy("g").agg(*exact.sums("v", "x"))
    got = sums.select("g", exact.mean("x").alias("m"), exact.deviation("x").alias("s"), exact.total("x").alias("t")).collect()
    return {r.g: (r.m, r.s, r.t) for r in got}


def test_moments_are_right_and_the_same_bits_in_any_order(spark):
    rows = [(g, v) for g, values in groups(1).items() for v in values]
    first = of(spark, rows, 7)
    for seed, parts in ((2, 1), (3, 3), (4, 16)):
        random.Random(seed).shuffle(rows)
        assert of(spark, rows, parts) == first
    for g, values in groups(1).items():
        m, s, t = first[g]
        # Values are held to 2^-55.
        assert abs(Fraction(m) - Fraction(sum(map(Fraction, values)), len(values))) < abs(m) * 2.0**-52 + 2.0**-54
        assert math.isclose(t, math.fsum(values), rel_tol=1e-15, abs_tol=1e-13)
        if len(values) > 1:
            true = float(math.sqrt(statistics.variance(map(Fraction, values))))
            assert math.isclose(s, true, rel_tol=1e-9, abs_tol=1e-15)
        else:
            assert s is None
        assert exact.moments(values) == (m, s)


def test_values_beyond_the_bound_and_nulls(spark):
    rows = [("big", 1e6), ("big", 3.0), ("null", None), ("null", 4.0), ("null", 6.0), ("none", None), ("nan", float("nan")), ("nan", 1.0)]
    got = of(spark, rows, 3)
    assert got["big"][0] == 500001.5 and math.isclose(got["big"][1], statistics.stdev([1e6, 3.0])) and got["big"][2] == 1000003.0
    assert got["null"] == (5.0, math.sqrt(2.0), 10.0)
    assert got["none"][:2] == (None, None)
    assert math.isnan(got["nan"][0]) and math.isnan(got["nan"][1])


@pytest.mark.parametrize("parts", [2, 9])
def test_advantages_are_bit_equal_under_repartitioning(spark, parts):
    rng = random.Random(7)
    rows = [(f"s{i}", f, b, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(40) for f in range(3) for b in range(4)]
    schema = "sent_id string, fwd_idx int, bwd_idx int, bleu double, chrf double"

    def run(rows, parts):
        df = spark.createDataFrame(rows, schema).repartition(parts)
        backward = rewards.advantages(df, ["sent_id", "fwd_idx"])
        forward = rewards.advantages(rewards.forward_rewards(df), ["sent_id"])
        zs = rewards.group_zscores(df, ["sent_id"], ["bleu"])
        return [sorted(map(tuple, x.collect())) for x in (backward, forward, zs)]

    first = run(rows, 1)
    rng.shuffle(rows)
    assert run(rows, parts) == first


def test_sums_combine_before_the_exchange(spark, plan):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    assert plan(df.groupBy("g").agg(*exact.sums("v", "x"))).count("HashAggregate") == 2
