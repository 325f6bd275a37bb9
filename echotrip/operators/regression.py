"""How well round-trip scores follow reference scores: filter, regression, mixed model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrip.functions.student import LOG_2_PI, NORMAL_95, normal_p, two_sided_p
from echotrip.session import stage

# Fixed values: (round-trip column, gold column) per metric, and the random-slope column.
PAIRS = {"bleu": ("roundtrip_bleu", "bleu"), "chrf": ("roundtrip_chrf", "chrf")}
SLOPE_COLUMN = "roundtrip_bleu"


def is_finite(value: str) -> Column:
    c = F.col(value)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_rows(df: DataFrame, metric: str) -> DataFrame:
    """Rows usable for a metric. The filter is cumulative: chrF starts from BLEU's survivors."""
    kept = df
    for name, pair in PAIRS.items():
        kept = kept.where(is_finite(pair[0]) & is_finite(pair[1]))
        if name == metric:
            return kept
    raise ValueError(f"Unknown metric: {metric}")


def linear_regression(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Slope, intercept, r, r2, n, standard error and t of y on x: one aggregation."""
    stats = df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(y, x).alias("r"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_count(y, x).alias("n"),
    )
    unexplained = F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0))
    freedom = F.when(F.col("n") > 2, F.col("n") - 2)
    stats = stats.withColumn(
        "stderr", F.sqrt(F.try_divide(unexplained * F.try_divide("_syy", "_sxx"), freedom))
    )
    return stats.withColumn("t", F.try_divide("slope", "stderr")).drop("_sxx", "_syy")


def with_p_value(regression: DataFrame) -> DataFrame:
    """Add the two-sided p-value to regression results."""
    return regression.withColumn("p", F.when(F.col("n") > 2, two_sided_p(F.col("t"), F.col("n") - 2)))


def fit_line(
    df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), points: int = 200
) -> DataFrame:
    """``points`` evenly spaced x between min and max with the fitted y."""
    fit = df.groupBy(*by).agg(
        F.min(x).alias("_low"),
        F.max(x).alias("_high"),
        F.regr_slope(y, x).alias("_slope"),
        F.regr_intercept(y, x).alias("_intercept"),
    )
    line = fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    line = line.withColumn(
        "x", F.col("_low") + F.col("i") * (F.col("_high") - F.col("_low")) / (points - 1)
    )
    return line.select(*by, "i", "x", (F.col("_slope") * F.col("x") + F.col("_intercept")).alias("y"))


def _group_sums(df: DataFrame, x: str, y: str, z: str, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count("*").cast("double").alias("n"),
        *[
            F.sum(expression).alias(name)
            for name, expression in {
                "sx": F.col(x),
                "sy": F.col(y),
                "sz": F.col(z),
                "sxx": F.col(x) * F.col(x),
                "sxy": F.col(x) * F.col(y),
                "syy": F.col(y) * F.col(y),
                "szz": F.col(z) * F.col(z),
                "szx": F.col(z) * F.col(x),
                "szy": F.col(z) * F.col(y),
            }.items()
        ],
    )


def _profile(sums: DataFrame, tried: dict[tuple, list[float]], by: list[str]) -> DataFrame:
    """REML criterion, its derivative and the estimates for each variance ratio tried per fit.

    One pass over the sums: the ratios are a literal array (or one small row per fit), and map-side combine
    leaves one row per task, fit and ratio.
    """
    if by:
        rows = [(*key, ratios) for key, ratios in tried.items()]
        kinds = [f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in by]
        points = sums.sparkSession.createDataFrame(rows, ", ".join([*kinds, "_tried array<double>"]))
        points = points.select(*[F.col(c).alias(f"_{c}") for c in by], "_tried")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        tried_rows = sums.join(points, same).withColumn("lam", F.explode("_tried"))
    else:
        tried_rows = sums.withColumn("lam", F.explode(F.array(*[F.lit(float(r)) for r in tried[()]]).cast("array<double>")))
    each = tried_rows.withColumn("c", F.col("lam") / (1 + F.col("lam") * F.col("szz")))
    each = each.withColumn("w", 1 / F.pow(1 + F.col("lam") * F.col("szz"), 2))

    def shrunk(total: str, left: str, right: str) -> Column:
        return F.sum(F.col(total) - F.col("c") * F.col(left) * F.col(right))

    def moved(left: str, right: str) -> Column:
        return -F.sum(F.col("w") * F.col(left) * F.col(right))

    a = each.groupBy(*by, "lam").agg(
        shrunk("n", "sz", "sz").alias("a11"),
        shrunk("sx", "sz", "szx").alias("a12"),
        shrunk("sxx", "szx", "szx").alias("a22"),
        shrunk("sy", "sz", "szy").alias("b1"),
        shrunk("sxy", "szx", "szy").alias("b2"),
        shrunk("syy", "szy", "szy").alias("q"),
        moved("sz", "sz").alias("d11"),
        moved("sz", "szx").alias("d12"),
        moved("szx", "szx").alias("d22"),
        moved("sz", "szy").alias("e1"),
        moved("szx", "szy").alias("e2"),
        moved("szy", "szy").alias("dq"),
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_groups"),
        F.sum(F.log1p(F.col("lam") * F.col("szz"))).alias("logdet"),
        F.sum(F.col("szz") / (1 + F.col("lam") * F.col("szz"))).alias("dlogdet"),
    )
    a = a.withColumn("det", F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12"))
    a = a.select(
        "*",
        F.try_divide(F.expr("a22 * b1 - a12 * b2"), "det").alias("intercept"),
        F.try_divide(F.expr("a11 * b2 - a12 * b1"), "det").alias("slope"),
    )
    a = a.withColumn("rest", F.expr("q - intercept * b1 - slope * b2"))
    a = a.withColumn("sigma2", F.try_divide("rest", F.col("n_rows") - 2))
    a = a.withColumn("criterion", F.expr("(n_rows - 2) * ln(sigma2) + logdet + ln(det)"))
    drest = "dq - 2 * (intercept * e1 + slope * e2) + intercept * intercept * d11 + 2 * intercept * slope * d12 + slope * slope * d22"
    ddet = "d11 * a22 + a11 * d22 - 2 * a12 * d12"
    return a.withColumn(
        "gradient", F.expr(f"(n_rows - 2) * try_divide({drest}, rest) + dlogdet + try_divide({ddet}, det)")
    )


def _best_ratios(sums: DataFrame, by: list[str], per_decade: int = 2, points: int = 33, passes: int = 12) -> dict[tuple, float]:
    """The variance ratio in [0, infinity) with the least criterion, per fit.

    Ratios are tried over decades around one over the mean of a group's z'z; the range is extended upwards for as
    long as the criterion falls. The bracket around the best is then narrowed where its derivative changes sign. A few
    numbers per fit and pass come back.
    """
    scales = {tuple(r[:-1]): r[-1] or 1.0 for r in sums.groupBy(*by).agg(F.avg("szz")).collect()}
    if not scales:
        return {}
    powers = [k / per_decade for k in range(-8 * per_decade, 8 * per_decade + 1)]
    grid = {key: [0.0] + [10.0**k / scale for k in powers] for key, scale in scales.items()}
    bracket: dict[tuple, tuple[float, float]] = {}
    while set(bracket) != set(scales):
        open_fits = {key: ratios for key, ratios in grid.items() if key not in bracket}
        found: dict[tuple, list] = {key: [] for key in open_fits}
        for row in _profile(sums, open_fits, by).collect():
            if row.criterion is not None and row.criterion == row.criterion:
                found[tuple(row[c] for c in by)].append((row.lam, row.criterion))
        for key, tried in found.items():
            tried.sort()
            if not tried:
                bracket[key] = (0.0, 0.0)
                continue
            at = min(range(len(tried)), key=lambda i: tried[i][1])
            if at == len(tried) - 1 and tried[at][0] < 1e200:
                grid[key] = [tried[max(at - 1, 0)][0]] + [tried[at][0] * 10.0**k for k in range(17)]
            else:
                bracket[key] = (tried[max(at - 1, 0)][0], tried[min(at + 1, len(tried) - 1)][0])
    for _ in range(passes):
        wide = {key: (lo, hi) for key, (lo, hi) in bracket.items() if hi - lo > 1e-12 * hi}
        if not wide:
            break
        tried = {key: [lo + i * (hi - lo) / (points - 1) for i in range(points)] for key, (lo, hi) in wide.items()}
        signs: dict[tuple, list] = {key: [] for key in wide}
        for row in _profile(sums, tried, by).collect():
            if row.criterion is not None and row.gradient is not None:
                signs[tuple(row[c] for c in by)].append((row.lam, row.gradient, row.criterion))
        for key, rows in signs.items():
            rows.sort()
            if len(rows) < 2:
                bracket[key] = (rows[0][0], rows[0][0]) if rows else (bracket[key][0], bracket[key][0])
                continue
            at = min(range(len(rows)), key=lambda i: rows[i][2])
            if rows[0][1] >= 0 and at == 0:
                bracket[key] = (rows[0][0], rows[0][0])
                continue
            # The last of the falling points next to the best: there the derivative changes sign.
            falling = [i for i in range(len(rows) - 1) if rows[i][1] < 0 <= rows[i + 1][1]]
            near = min(falling, key=lambda i: abs(i - at)) if falling else max(at - 1, 0)
            bracket[key] = (rows[near][0], rows[min(near + 1, len(rows) - 1)][0])
    return {key: (lo + hi) / 2 for key, (lo, hi) in bracket.items()}


def mixed_model(
    df: DataFrame, x: str, y: str, z: str = SLOPE_COLUMN, group: str = "sent_idx", by: tuple[str, ...] = ()
) -> DataFrame:
    """y ~ 1 + x with a random slope of z per group and no random intercept, fitted by REML.

    One row per fit (``by``): intercept, slope, their standard errors, sigma2, slope_variance, lam,
    criterion, n_rows, n_groups. Groups shrink to ten sums, staged once; the variance ratio
    ``lam`` is searched without an upper limit. No rows, no fits.
    """
    sums = stage(_group_sums(df, x, y, z, [*by, group]), "sums")
    best = _best_ratios(sums, list(by))
    winner = _profile(sums, {key: [ratio] for key, ratio in best.items()} or ({} if by else {(): []}), list(by))
    return winner.select(
        *by,
        "intercept",
        "slope",
        F.sqrt(F.expr("sigma2 * a22 / det")).alias("intercept_se"),
        F.sqrt(F.expr("sigma2 * a11 / det")).alias("slope_se"),
        "sigma2",
        (F.col("lam") * F.col("sigma2")).alias("slope_variance"),
        "lam",
        "criterion",
        F.col("n_rows").cast("bigint").alias("n_rows"),
        "n_groups",
    )


def mixed_summary(fits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Significance of a ``mixed_model`` table: one row per fit and coefficient.

    coefficient (intercept, slope), estimate, se, z, p (two-sided, normal), low and high (95 %), and the fit's REML log_likelihood,
    n_rows and n_groups. Without residual degrees of freedom all are NULL but the counts.
    """
    freedom = F.col("n_rows") - 2
    likelihood = -(F.col("criterion") + freedom * (1 + LOG_2_PI)) / 2
    both = F.array(*[F.struct(F.lit(c).alias("coefficient"), F.col(c).alias("estimate"), F.col(f"{c}_se").alias("se")) for c in ("intercept", "slope")])
    rows = fits.select(*by, F.inline(both), likelihood.alias("log_likelihood"), "n_rows", "n_groups")
    rows = rows.withColumn("z", F.try_divide("estimate", "se"))
    return rows.select(
        *by, "coefficient", "estimate", "se", "z", normal_p(F.col("z")).alias("p"),
        (F.col("estimate") - NORMAL_95 * F.col("se")).alias("low"), (F.col("estimate") + NORMAL_95 * F.col("se")).alias("high"),
        "log_likelihood", "n_rows", "n_groups",
    )


def predicted_slopes(
    df: DataFrame, fits: DataFrame, x: str, y: str, z: str = SLOPE_COLUMN, group: str = "sent_idx", by: tuple[str, ...] = ()
) -> DataFrame:
    """The random slope of every group as its fit predicts it, from the group's own sums: by, group, n, predicted (deviation from 0
    of the slope of ``z``), and its share of shrinkage (0: all the way to 0, 1: none)."""
    sums = _group_sums(df, x, y, z, [*by, group])
    wanted = fits.select(*[F.col(c).alias(f"_{c}") for c in by], "intercept", "slope", "lam")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or [F.lit(True)]
    joined = sums.join(F.broadcast(wanted), same) if not by else sums.join(wanted, same)
    residual = F.expr("szy - intercept * sz - slope * szx")
    scale = 1 + F.col("lam") * F.col("szz")
    return joined.select(
        *by, group, F.col("n").cast("bigint").alias("n"),
        (F.col("lam") * residual / scale).alias("predicted"),
        (F.col("lam") * F.col("szz") / scale).alias("kept_share"),
    )
