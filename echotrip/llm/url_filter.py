"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for urls without a rule.

Everything is DataFrame functions and Spark ML. Urls are judged where they lie; only training, on a table of bounded size, shuffles.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.
A null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the model like any other text.
A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, of equally long ones ``block``.
Repeated rows are judged each; an empty table gives an empty result. A labelled table of one verdict makes the model
give that verdict, an empty one ``allow``.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrip.session import stage

ALLOW, BLOCK = "allow", "block"
Rules = list[tuple[str, str]]  # (verdict, host/path), few: they become one expression


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (3, 4)
    buckets: int = 1 << 14
    sample: int = 4_000  # labelled urls to train on, at most
    steps: int = 40
    penalty: float = 1e-3
    threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    fitted: LogisticRegressionModel | None
    constant: float  # chance of ``block`` where nothing was fitted


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Rules) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    cases = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == BLOCK)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        cases = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(cases)
    return cases


def grams(host: Column, path: Column, sizes: tuple[int, ...]) -> Column:
    """All character n-grams of host and path with marked ends, as an array."""
    whole = F.concat(F.lit("^"), host, path, F.lit("$"))
    parts = []
    for n in sizes:
        last = F.length(whole) - (n - 1)
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i, n=n: F.substr(whole, i, F.lit(n)))
        parts.append(F.when(last >= 1, pieces).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def _vectors(rows: DataFrame, s: Settings) -> DataFrame:
    with_grams = rows.withColumn("__grams", grams(F.col("__host"), F.col("__path"), s.sizes))
    return HashingTF(numFeatures=s.buckets, binary=True, inputCol="__grams", outputCol="__features").transform(with_grams)


def train(labelled: DataFrame, url_col: str = "url", verdict_col: str = "verdict", settings: Settings = Settings()) -> Model:
    """``labelled`` (url, allow or block): the first ``sample`` distinct rows in hash order are learnt from."""
    s = settings
    rows = labelled.where(F.col(verdict_col).isin(ALLOW, BLOCK)).select(
        host_of(F.col(url_col)).alias("__host"),
        path_of(F.col(url_col)).alias("__path"),
        (F.col(verdict_col) == BLOCK).cast("double").alias("label"),
    )
    rows = rows.distinct().orderBy(F.xxhash64("__host", "__path"), "__host", "__path", "label").limit(s.sample)
    rows = stage(rows, "urls")
    seen = rows.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if seen.lo is None or seen.lo == seen.hi:
        return Model(None, seen.lo or 0.0)
    learner = LogisticRegression(
        featuresCol="__features", labelCol="label", maxIter=s.steps, regParam=s.penalty, standardization=False
    )
    return Model(learner.fit(_vectors(rows, s).select("__features", "label")), 0.0)


def judge(pages: DataFrame, rules: Rules, model: Model, id_col: str = "page_id", url_col: str = "url", settings: Settings = Settings()) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, chance (of ``block``; null where a rule decides)."""
    rows = pages.select(F.col(id_col).alias("__id"), host_of(F.col(url_col)).alias("__host"), path_of(F.col(url_col)).alias("__path"))
    rows = rows.withColumn("__rule", rule_for(F.col("__host"), F.col("__path"), rules))
    if model.fitted is None:
        scored = rows.withColumn("__chance", F.lit(model.constant))
    else:
        fitted = model.fitted.setProbabilityCol("__probability").setRawPredictionCol("").setPredictionCol("")
        scored = fitted.transform(_vectors(rows, settings))
        scored = scored.withColumn("__chance", vector_to_array("__probability")[1])
    guess = F.when(F.col("__chance") >= settings.threshold, BLOCK).otherwise(ALLOW)
    return scored.select(
        F.col("__id").alias(id_col),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), guess).alias("verdict"),
        F.when(F.col("__rule").isNull(), F.col("__chance")).alias("chance"),
    )
