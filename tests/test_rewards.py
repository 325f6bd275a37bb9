import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrip.functions import student
from echotrip.operators import policy, regression, rewards

SCHEMA = "sent_id string, fwd_idx int, bwd_idx int, bleu double, chrf double"


def advantages_of(df, keys, *ids):
    return {tuple(r[i] for i in ids): r for r in rewards.advantages(df, keys).collect()}


def test_worked_example(spark):
    """Rewards 0.531/0.765 and 0.406/1.000 under two candidates of one sentence."""
    rows = [("s", 0, 0, 0.531, 1.0), ("s", 0, 1, 0.765, 1.0), ("s", 1, 0, 0.406, 5.0), ("s", 1, 1, 1.0, 7.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    back = advantages_of(df, ["sent_id", "fwd_idx"], "fwd_idx", "bwd_idx")
    assert [round(back[k].adv_bleu, 4) for k in sorted(back)] == [-0.7071, 0.7071, -0.7071, 0.7071]
    assert back[0, 0].adv_chrf == 0.0  # constant group
    for how, expected in (("sum", [1.296, 1.406]), ("mean", [0.648, 0.703])):
        forward = rewards.forward_rewards(df, how=how)
        got = {r.fwd_idx: r.bleu for r in forward.collect()}
        assert [round(got[k], 9) for k in (0, 1)] == expected
        adv = advantages_of(forward, ["sent_id"], "fwd_idx")
        assert [round(adv[(k,)].adv_bleu, 4) for k in (0, 1)] == [-0.7071, 0.7071]


def test_group_of_one_and_choice(spark):
    df = spark.createDataFrame([("s", 0, 0, 3.0, 4.0), ("t", 0, 0, 1.0, 2.0), ("t", 1, 0, 3.0, 2.0)], SCHEMA)
    got = advantages_of(df, ["sent_id"], "sent_id", "fwd_idx")
    assert (got["s", 0].adv_bleu, got["s", 0].group_size) == (0.0, 1)
    chosen = rewards.advantages(df, ["sent_id"]).select(
        "sent_id", "fwd_idx", *[rewards.chosen_advantage(m).alias(m) for m in ("bleu", "chrf", "both")]
    )
    row = chosen.where("sent_id = 't' AND fwd_idx = 1").first()
    assert row.bleu == pytest.approx(1 / math.sqrt(2)) and row.chrf == 0.0 and row.both == row.bleu / 2
    with pytest.raises(ValueError):
        rewards.chosen_advantage("comet")


def test_equal_values_whose_mean_misses_them(spark):
    df = spark.createDataFrame([("s", i, 0, 0.1, 0.7) for i in range(3)], SCHEMA)
    assert {r.adv_bleu for r in rewards.advantages(df, ["sent_id"]).collect()} == {0.0}
    assert {r.bleu for r in rewards.group_zscores(df, ["sent_id"], ["bleu"]).collect()} == {None}


def test_hot_groups(spark):
    """One group holds most rows, all of one reward; its rows keep to several tasks and no window gathers them."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 100 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 400)).alias("sent_id"),
        F.col("id").cast("int").alias("fwd_idx"),
        F.lit(0).alias("bwd_idx"),
        F.when(F.col("id") % 10 > 0, 0.0).otherwise((F.col("id") * 37 % 101).cast("double")).alias("bleu"),
        (F.col("id") * 17 % 89).cast("double").alias("chrf"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "50",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        moments = rewards.with_group_moments(df, ["sent_id"], ["bleu", "chrf"]).withColumn("task", F.spark_partition_id())
        rows = moments.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    hot = [r for r in rows if r.sent_id == "hot"]
    assert len(rows) == 30_000 and {r._n for r in hot} == {27_000} and len({r.task for r in hot}) > 2
    assert {r._n for r in rows if r.sent_id is None} == {300}
    assert {(r._bleu_min, r._bleu_max) for r in hot} == {(0.0, 0.0)}
    got = {r.fwd_idx: r for r in rewards.advantages(df, ["sent_id"]).collect()}
    assert got[1].adv_bleu == 0.0 and got[1].group_size == 27_000


def test_advantages_sum_to_zero_and_survive_repartitioning(spark):
    df = spark.range(500).select(
        (F.col("id") % 60).cast("string").alias("sent_id"), F.col("id").cast("int").alias("fwd_idx"),
        F.lit(0).alias("bwd_idx"), F.rand(3).alias("bleu"), F.rand(4).alias("chrf"),
    ).cache()
    one = rewards.advantages(df, ["sent_id"])
    sums = one.groupBy("sent_id").agg(F.sum("adv_bleu").alias("s")).collect()
    assert all(abs(r.s) < 1e-9 for r in sums)
    other = rewards.advantages(df.repartition(13), ["sent_id"])
    first, second = ({r.fwd_idx: r.adv_chrf for r in d.collect()} for d in (one, other))
    assert first.keys() == second.keys()
    assert all(first[k] == pytest.approx(second[k], abs=1e-9) for k in first)


# --- regression ---


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = 0.4 * x + rng.normal(size=300) + 0.1
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = regression.with_p_value(regression.linear_regression(df, "x", "y")).first()
    slope, intercept = np.polyfit(x, y, 1)
    residual = y - slope * x - intercept
    se = math.sqrt((residual @ residual) / 298 / ((x - x.mean()) @ (x - x.mean())))
    assert [fit.slope, fit.intercept, fit.r, fit.stderr] == pytest.approx(
        [slope, intercept, np.corrcoef(x, y)[0, 1], se], rel=1e-9
    )
    assert fit.r2 == pytest.approx(fit.r**2) and fit.n == 300 and fit.p < 1e-6
    line = regression.fit_line(df, "x", "y").orderBy("i").collect()
    assert np.allclose([r.x for r in line], np.linspace(x.min(), x.max(), 200))
    assert np.allclose([r.y for r in line], slope * np.linspace(x.min(), x.max(), 200) + intercept)


def p_values(spark, pairs):
    df = spark.createDataFrame([(i, t, float(n)) for i, (t, n) in enumerate(pairs)], "i int, t double, n double")
    rows = df.select("i", student.two_sided_p(F.col("t"), F.col("n")).alias("p"), student.normal_p(F.col("t")).alias("z")).orderBy("i").collect()
    return [r.p for r in rows], [r.z for r in rows]


def test_student_t_known_values(spark):
    # Table values of the two-sided 5% and 1% points, exact cases for 1 and 2 degrees, and the ends.
    known = [(2.228139, 10, 0.05), (3.169273, 10, 0.01), (1.983972, 100, 0.05), (1.0, 1, 0.5), (0.0, 7, 1.0), (-1.0, 1, 0.5)]
    got, _ = p_values(spark, [k[:2] for k in known])
    assert got == pytest.approx([k[2] for k in known], abs=1e-6)
    got, _ = p_values(spark, [(2.0, 2), (40.0, 1000), (float("inf"), 5), (1e200, 5), (1e-200, 5), (3.0, 0.5)])
    assert got[0] == pytest.approx(1 - 2 / math.sqrt(6), abs=1e-12) and got[1] == pytest.approx(7.5e-211, rel=1)
    assert got[2:] == [0.0, 0.0, 1.0, None]
    rows = spark.createDataFrame([(None, 3.0), (1.0, None)], "t double, n double")
    assert [r[0] for r in rows.select(student.two_sided_p(F.col("t"), F.col("n"))).collect()] == [None, None]


def test_t_probability_is_the_integral_of_its_density(spark):
    pairs = [(t, n) for n in (1, 3, 8, 41, 300, 4000) for t in (0.05, 0.7, 1.6, 1.75, 2.5, 6.0)]
    got, _ = p_values(spark, pairs)
    for (t, n), p in zip(pairs, got):
        u = np.linspace(0, t, 20_001)
        front = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
        assert p == pytest.approx(1 - 2 * np.trapezoid(front * (1 + u * u / n) ** (-(n + 1) / 2), u), abs=1e-8)


def test_p_value_needs_no_python_worker(spark, plan):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 2.5)], "x double, y double")
    assert "Python" not in plan(regression.with_p_value(regression.linear_regression(df.repartition(2), "x", "y")).drop("x")).replace("Scan ExistingRDD", "")


def test_normal_probability(spark):
    zs = [0.0, 1e-8, 0.3, -1.2, 1.959963984540054, 2.4999, 2.5, 2.6, 5.0, -9.0, 37.0]
    _, got = p_values(spark, [(z, 5) for z in zs])
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=1e-10)


def test_mixed_summary_and_predicted_slopes(spark):
    rng = np.random.default_rng(12)
    slopes = rng.normal(0, 2, 25)
    rows = [(g, float(x), float(1 + 0.5 * x + slopes[g] * z + rng.normal()), float(z)) for g in range(25) for x, z in rng.normal(size=(12, 2))]
    df = spark.createDataFrame(rows, "sent_idx long, x double, y double, z double")
    fits = regression.mixed_model(df, "x", "y", "z")
    fit = fits.first()
    table = {r.coefficient: r for r in regression.mixed_summary(fits).collect()}
    for name in ("intercept", "slope"):
        r = table[name]
        assert (r.estimate, r.se) == (fit[name], fit[f"{name}_se"]) and r.z == pytest.approx(r.estimate / r.se)
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-9, abs=1e-300) and r.n_groups == 25
        assert (r.low, r.high) == pytest.approx((r.estimate - 1.959963984540054 * r.se, r.estimate + 1.959963984540054 * r.se))
    # The REML likelihood from whole covariance matrices.
    x = np.array([[1, r[1]] for r in rows])
    y, z, g = (np.array([r[i] for r in rows]) for i in (2, 3, 0))
    v = fit.sigma2 * (np.eye(len(y)) + fit.lam * (g[:, None] == g) * np.outer(z, z))
    inverse = np.linalg.inv(v)
    inner = x.T @ inverse @ x
    beta = np.linalg.solve(inner, x.T @ inverse @ y)
    rest = y - x @ beta
    # The constant of the design's own size is left out, as usual.
    whole = -(np.linalg.slogdet(v)[1] + np.linalg.slogdet(inner)[1] + rest @ inverse @ rest + (len(y) - 2) * math.log(2 * math.pi)) / 2
    assert table["slope"].log_likelihood == pytest.approx(whole, rel=1e-9)
    got = {r.sent_idx: r for r in regression.predicted_slopes(df, fits, "x", "y", "z").collect()}
    predicted = fit.lam * fit.sigma2 * np.array([z[g == k] @ (inverse @ rest)[g == k] for k in range(25)])
    assert [got[k].predicted for k in range(25)] == pytest.approx(predicted.tolist(), rel=1e-8)
    assert np.corrcoef(predicted, slopes)[0, 1] > 0.9 and all(0 < r.kept_share < 1 and r.n == 12 for r in got.values())


def test_regression_of_too_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    fit = regression.with_p_value(regression.linear_regression(df, "x", "y")).first()
    assert fit.slope == 1.0 and fit.stderr is None and fit.p is None


def _reml(lam, groups):
    """Criterion and estimates by inverting each group's covariance matrix."""
    a, b, q, logdet, n = np.zeros((2, 2)), np.zeros(2), 0.0, 0.0, 0
    for x, y, z in groups:
        v = np.eye(len(x)) + lam * np.outer(z, z)
        inverse = np.linalg.inv(v)
        design = np.column_stack([np.ones(len(x)), x])
        a += design.T @ inverse @ design
        b += design.T @ inverse @ y
        q += y @ inverse @ y
        logdet += np.linalg.slogdet(v)[1]
        n += len(x)
    beta = np.linalg.solve(a, b)
    sigma2 = (q - beta @ b) / (n - 2)
    return (n - 2) * math.log(sigma2) + logdet + np.linalg.slogdet(a)[1], beta, sigma2, a


def test_mixed_model_against_brute_force(spark):
    rng = np.random.default_rng(11)
    groups, rows = [], []
    for g in range(60):
        z = rng.normal(size=rng.integers(3, 9))
        x = 0.7 * z + rng.normal(size=len(z))
        y = 0.3 + 0.5 * x + rng.normal(0, 0.8) * z + rng.normal(size=len(z))
        groups.append((x, y, z))
        rows += [(g, float(a), float(b), float(c)) for a, b, c in zip(x, y, z)]
    df = spark.createDataFrame(rows, "sent_idx long, x double, y double, roundtrip_bleu double")
    fit = regression.mixed_model(df, "x", "y").first()
    criterion, beta, sigma2, a = _reml(fit.lam, groups)
    assert [fit.criterion, fit.intercept, fit.slope, fit.sigma2] == pytest.approx(
        [criterion, *beta, sigma2], rel=1e-9
    )
    assert [fit.intercept_se, fit.slope_se] == pytest.approx(
        list(np.sqrt(sigma2 * np.diag(np.linalg.inv(a)))), rel=1e-9
    )
    best = min(_reml(u / (1 - u), groups)[0] for u in np.linspace(0, 0.99, 1000))
    assert fit.criterion <= best + 1e-9 and (fit.n_groups, fit.n_rows) == (60, len(rows))


def test_mixed_model_has_no_largest_ratio(spark):
    """Strong slopes, none at all, and a fit of its own for each; the best ratio is found whatever its size."""
    rng = np.random.default_rng(5)
    fits, rows = {}, []
    for name, spread, noise in (("steep", 20.0, 0.5), ("steeper", 2e3, 1e-2), ("none", 0.0, 1.0)):
        for g in range(60):
            z = rng.normal(size=8)
            y = 0.2 + z + rng.normal(0, spread) * z + rng.normal(0, noise, size=8) if spread else 0.2 + z + np.tile([1.0, -1.0], 4) * noise
            fits.setdefault(name, []).append((z, y, z))
            rows += [(name, g, float(a), float(b)) for a, b in zip(z, y)]
    df = spark.createDataFrame(rows, "name string, sent_idx long, x double, y double")
    got = {r.name: r for r in regression.mixed_model(df, "x", "y", "x", by=("name",)).collect()}
    assert 500 < got["steep"].lam < 5000 and 200 < got["steep"].slope_variance < 800 and got["steeper"].lam > 1e9
    for name in ("steep", "none"):
        criterion, beta, sigma2, _ = _reml(got[name].lam, fits[name])
        assert [got[name].criterion, got[name].slope, got[name].sigma2] == pytest.approx([criterion, beta[1], sigma2], rel=1e-6)
        tried = [got[name].lam * f for f in (0.9, 0.99, 1.01, 1.1)] + [0.0, 1e-3, 10.0, 1e5]
        assert criterion <= min(_reml(t, fits[name])[0] for t in tried) + 1e-7
    assert regression.mixed_model(df.where("false"), "x", "y", "x", by=("name",)).collect() == []


def test_p_value_with_many_rows(spark):
    freedoms = (1e2, 1e4, 1e6, 1e8, 1e10, 1e12)
    for t in (0.01, 1.8, 4.0):
        got, _ = p_values(spark, [(t, n) for n in freedoms])
        for p, freedom in zip(got, freedoms):
            assert p == pytest.approx(math.erfc(t / math.sqrt(2)), abs=3 / freedom + 1e-9)


def test_finite_filter_is_cumulative(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0), (2, 1.0, nan, 1.0, 1.0), (3, 1.0, 1.0, inf, 1.0), (4, 1.0, 1.0, 1.0, -inf)]
    df = spark.createDataFrame(rows, "i int, bleu double, roundtrip_bleu double, chrf double, roundtrip_chrf double")
    assert sorted(r.i for r in regression.finite_rows(df, "bleu").collect()) == [0, 3, 4]
    assert sorted(r.i for r in regression.finite_rows(df, "chrf").collect()) == [0]
    with pytest.raises(ValueError):
        regression.finite_rows(df, "ter")


# --- logged log-probabilities ---


def test_masks(spark):
    df = spark.createDataFrame([(6, 2), (3, 0), (3, -1), (2, 5), (0, 0)], "length int, c int")
    got = [r[0] for r in df.select(policy.tail_mask(F.col("length"), F.col("c"))).collect()]
    assert got == [[0, 0, 0, 0, 1, 1], [0, 0, 0], [0, 0, 0], [1, 1], []]
    row = spark.range(1).select(policy.label_mask(F.array(*[F.lit(x) for x in (5, 0, 7)]), 0)).first()
    assert row[0] == [1, 0, 1]
    empty = spark.createDataFrame([(1, 0, [1]), (2, 3, [0, 0, 0]), (3, 2, [0, 1])], "i int, n int, m array<int>")
    assert {r.i: r.reason for r in policy.empty_completions(empty, "n", "m").collect()} == {1: "no_tokens", 2: "mask_all_zero"}


def test_sequence_terms_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        n = int(rng.integers(1, 12))
        old, pol, ref = (-rng.random(n) * 2 for _ in range(3))
        mask = rng.integers(0, 2, n)
        rows.append((i, float(rng.normal()), *(list(map(float, a)) for a in (old, pol, ref)), list(map(int, mask))))
    df = spark.createDataFrame(rows, "i int, advantage double, old array<double>, policy array<double>, ref array<double>, mask array<int>")
    for beta in (0.1, 0.0):
        got = {r.i: r for r in policy.sequence_terms(df, beta=beta).collect()}
        for i, adv, old, pol, ref, mask in rows:
            old, pol, ref, mask = map(np.array, (old, pol, ref, mask))
            ratio = np.exp(pol - old)
            objective = np.minimum(ratio * adv, np.clip(ratio, 0.8, 1.2) * adv)
            kl = np.exp(ref - pol) - (ref - pol) - 1
            if mask.sum() == 0:
                assert got[i].loss is None and got[i].kl is None
            else:
                assert got[i].loss == pytest.approx(((-(objective - beta * kl)) * mask).sum() / mask.sum())
                assert got[i].kl == pytest.approx((kl * mask).sum() / mask.sum())


def test_direction_mix_and_step_log(spark):
    losses = spark.createDataFrame([(1, "forward", 2.0), (1, "backward", 4.0)], "run int, direction string, loss double")
    for alpha, expected in ((0.25, 3.5), (0.0, 4.0), (1.0, 2.0)):
        assert policy.mix_directions(losses, ["run"], alpha).first().loss == expected
    rows = [(b // 5, b, float(b), 2.0 * b, 0.5, 0.25, 10.0 * b, 1.0) for b in range(10)]
    batches = spark.createDataFrame(
        rows, "epoch int, batch int, fwd_loss double, bwd_loss double, fwd_kl double, bwd_kl double, reward_bleu double, reward_chrf double"
    )
    steps = policy.step_log(batches, 4, alpha=0.25).orderBy("step").collect()
    assert [(r.step, r.epoch) for r in steps] == [(0, 0), (1, 1)]  # two trailing batches fill no step
    assert steps[1].fwd_loss == pytest.approx(0.25 * (4 + 5 + 6 + 7) / 4)
    assert steps[0].bwd_loss == pytest.approx(0.75 * 2 * 6 / 4)
    assert (steps[0].fwd_kl, steps[1].reward_bleu) == (0.5, 55.0)
    epochs = policy.epoch_log(policy.step_log(batches, 4)).orderBy("epoch").collect()
    assert [(r.epoch, r.reward_bleu, r.n_steps) for r in epochs] == [(0, 15.0, 1), (1, 55.0, 1)]


def test_log_rows_are_exchanged_without_the_logs_that_follow(spark, tmp_path, plan):
    """Only the old log-probabilities go through the join of the advantages; the rest is made after it."""
    from workload import tables

    text = "One two three four five six. Seven eight nine ten eleven twelve thirteen!"
    spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    old = tables.old_logs(spark, str(tmp_path))
    assert old.columns == ["sent_id", "fwd_idx", "bleu", "chrf", "old"] and old.count() == 12
    logs = tables.token_logs(rewards.advantages(old, ["sent_id"]))
    below_join = plan(logs).split("Join", 1)[1]
    assert "AS policy" not in below_join and "AS mask" not in below_join
    first = logs.where("sent_id = '1:0' and fwd_idx = 1").first()
    assert first.old == pytest.approx([-0.4, -0.45, -0.7, -0.5, -0.55]) and first.mask == [0, 0, 1, 1, 1]


def test_kl_is_made_once_a_row(spark, plan):
    df = spark.createDataFrame([([0.0, -1.0], [0.1, -1.0], [0.2, -0.5], [0, 1], 1.0)], "old array<double>, policy array<double>, ref array<double>, mask array<int>, advantage double")
    df = df.repartition(2)
    assert plan(policy.sequence_terms(df)).count("EXP((lambda") <= 2  # the ratio and the KL
