"""Mixing to target weights with soft domain membership.

A classifier learnt from a labelled table gives every document a posterior over domains. Its tokens count towards each domain in that
proportion, and nonnegative document rates are fitted so that the expected tokens of each domain match their targets: projected
gradient descent on the squared misses, each relative to the domain's tokens, from rate 1 for every document. Where domains overlap plain
steps are slow, so a step is scaled by the Gram matrix of the domains over the documents that are free to move (a few numbers per
pair of domains); parts of it and plain steps are tried in the same aggregation, and the best is taken. Steps end when all targets are met, or when
none makes progress any more because the targets cannot be met; the misses that remain come with the result. The posteriors and
lengths are staged once; a step is one aggregation of a few sums per domain, and rates are an expression over the steps so far,
so nothing about a document ever leaves the executors. Everything is DataFrame functions and Spark ML.

Rates are expected numbers of copies; ``repeat`` turns them into whole copies by a hash of the id, or of the text where there is no id.

Defined results: null and empty texts have no tokens and the posterior of an empty text; repeated rows have a rate each; rows without an
id are mixed as all others; domains without any
expected tokens cannot be filled and are left out; without labels, or with one domain, all posteriors are equal; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrip.session import stage


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 12
    sample: int = 3_000  # labelled documents to learn from, about, drawn by a hash of the text
    learner_steps: int = 50
    penalty: float = 1e-5
    tolerance: float = 1e-9  # of the largest relative miss
    progress: float = 1e-2  # share by which the squared misses fall in two steps, at least, or the targets cannot be met
    restage: int = 5  # steps after which rates are written and read again


def words(text: Column) -> Column:
    """Words of the whole text, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]"), lambda w: w != "")


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], text_col: str, domain_col: str, s: Settings) -> DataFrame:
    """``docs`` with __n (tokens) and __p (posterior of each of ``domains``)."""
    known = labelled.where(F.col(domain_col).isin(domains)).select(F.col(text_col).alias("__text"), F.col(domain_col).alias("__domain"))
    share = s.sample / max(known.count(), 1)
    known = known.where(F.pmod(F.xxhash64(F.lit(17), "__text"), F.lit(1 << 20)) < share * (1 << 20))
    index = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("__domain")) - 1
    known = stage(known.select(words(F.col("__text")).alias("__words"), index.cast("double").alias("__label")), "labelled")
    rows = docs.withColumn("__words", words(F.col(text_col))).withColumn("__n", F.size("__words").cast("double"))
    found = known.agg(F.collect_set("__label").alias("labels")).first().labels
    if len(found) < 2:
        share = F.array(*[F.lit(1.0 / len(domains)) for _ in domains])
        return rows.withColumn("__p", share).drop("__words")
    shape = [
        HashingTF(numFeatures=s.buckets, inputCol="__words", outputCol="__counts"),
        Normalizer(p=2.0, inputCol="__counts", outputCol="__features"),
    ]
    features = PipelineModel(shape)
    learner = LogisticRegression(
        featuresCol="__features", labelCol="__label", family="multinomial", maxIter=s.learner_steps, regParam=s.penalty, standardization=False
    )
    fitted = learner.fit(features.transform(known)).setProbabilityCol("__probability").setRawPredictionCol("").setPredictionCol("")
    chance = vector_to_array("__probability")
    last = fitted.numClasses
    padded = F.array(*[chance[k] if k < last else F.lit(0.0) for k in range(len(domains))])
    return fitted.transform(features.transform(rows)).withColumn("__p", padded).drop("__words", "__counts", "__features", "__probability")


def fit_rates(held: DataFrame, targets: list[float], s: Settings = Settings()) -> tuple[DataFrame, list[float]]:
    """``held`` has __n and __p; adds __rate. ``targets`` are the wanted expected tokens of each domain. Also the misses
    that remain, each relative to the domain's tokens (0 for a domain without any)."""
    count = len(targets)
    pairs = [(k, m) for k in range(count) for m in range(k, count)]
    p = [F.col("__p")[k] for k in range(count)]

    def look(held: DataFrame, rates: list[Column]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each rate, in one aggregation: expected tokens, and the Gram matrix over the rows whose rate is above 0."""
        named = held.withColumns({f"__r{i}": rate for i, rate in enumerate(rates)})
        sums = []
        for i in range(len(rates)):
            r = F.col(f"__r{i}")
            free = F.when(r > 0, F.col("__n")).otherwise(0.0)
            sums += [F.sum(F.col("__n") * p[k] * r) for k in range(count)] + [F.sum(free * p[k] * p[m]) for k, m in pairs]
        row = list(named.agg(*[F.coalesce(x, F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(sums)]).first()) if sums else []
        out = []
        for _ in rates:
            gram = np.zeros((count, count))
            for (k, m), x in zip(pairs, row[count:]):
                gram[k, m] = gram[m, k] = x
            out.append((np.array(row[:count]), gram))
            row = row[count + len(pairs) :]
        return out

    def moved(rate: Column, by: np.ndarray) -> Column:
        slope = sum((p[k] * F.lit(float(by[k])) for k in range(count)), F.lit(0.0))
        return F.greatest(F.lit(0.0), rate - slope)

    def misses(now: np.ndarray) -> np.ndarray:
        return np.array([(now[k] - targets[k]) / totals[k] if totals[k] > 0 else 0.0 for k in range(count)])

    rate = F.lit(1.0)
    totals, gram = look(held, [rate])[0]
    miss = misses(totals)
    history = [float(miss @ miss)]
    while count and np.abs(miss).max() > s.tolerance:
        scaled = np.linalg.lstsq(gram, miss * totals, rcond=1e-12)[0]
        tried = [moved(rate, by) for by in (scaled, scaled / 4, scaled / 16, scaled / 64, miss, 8 * miss)]
        found = [(misses(now), there) for now, there in look(held, tried)]
        best = min(range(len(found)), key=lambda i: float(found[i][0] @ found[i][0]))
        if not found[best][0] @ found[best][0] < history[-1]:
            break
        rate, (miss, gram) = tried[best], found[best]
        history.append(float(miss @ miss))
        if len(history) > 2 and history[-1] > (1 - s.progress) * history[-3]:
            break
        if len(history) % s.restage == 0:
            held = stage(held.withColumn("__rate", rate), "rates")
            rate = F.col("__rate")
    return held.withColumn("__rate", rate), [float(x) for x in miss]


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float],
    total: float | None = None,
    lossless: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "lang",
    settings: Settings = Settings(),
    keyed: bool = False,
) -> DataFrame:
    """One row per document: id, n_tokens, posterior (by the order of ``weights``), rate, miss (what remains of each domain's miss, relative
    to its tokens; the same in every row); if ``keyed``, also text_key, a hash of the text.

    ``labelled`` holds texts and their domains; the documents' own domain column is never looked at. ``total`` is the wanted number
    of expected tokens (default: as many as there are); ``lossless`` raises it, at the same shares, until no document's rate is
    below 1 (without effect if some rate is 0).
    """
    s, domains = settings, list(weights)
    share = [weights[d] / sum(weights.values()) for d in domains]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__body"))
    named = labelled.select(F.col(text_col).cast("string").alias("__body"), F.col(domain_col).alias("__named"))
    held = posteriors(rows, named, domains, "__body", "__named", s).select("__id", *[text_key("__body").alias("__key")] * keyed, "__n", "__p")
    held = stage(held, "posteriors")
    sums = held.agg(*[F.coalesce(F.sum(F.col("__n") * F.col("__p")[k]), F.lit(0.0)) for k in range(len(domains))]).first()
    if total is None:
        total = max((x / w for x, w in zip(sums, share) if w > 0), default=0.0) if lossless else sum(sums)
    fitted, miss = fit_rates(held, [total * w for w in share], s)
    if lossless:
        least = fitted.where("__n > 0").agg(F.min("__rate")).first()[0] or 1.0
        fitted = fitted.withColumn("__rate", F.col("__rate") / least)
    shown = [F.col("__id").alias(id_col), F.col("__n").cast("bigint").alias("n_tokens"), F.col("__p").alias("posterior"), F.col("__rate").alias("rate")]
    shown.append(F.array(*[F.lit(x) for x in miss]).alias("miss"))
    return fitted.select(*shown, *[F.col("__key").alias("text_key")] * keyed)


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def repeat(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as its rate says: the whole part, and once more with the chance of the rest.

    Null ids meet null ids. With keyed ``rates``, rows of one id and different texts, and rows without an id, have each their own rate;
    else the least of their id's.
    """
    keys = {"__id": F.col(id_col)} | ({"__key": F.col("text_key")} if "text_key" in rates.columns else {})
    rates = rates.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.min("rate").alias("__rate"))
    docs, columns = docs.withColumn("__text_key", text_key(text_col)), docs.columns
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    if "__key" in keys:
        same &= F.col("__text_key") == F.col("__key")
    drawn = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(29), "__text_key")).otherwise(F.xxhash64(F.lit(29), id_col))
    draw = F.pmod(drawn, F.lit(1 << 24)) / float(1 << 24)
    copies = F.floor(F.col("__rate") + draw).cast("int")
    joined = docs.join(rates, same).withColumn("__copies", copies)
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select(*columns)
