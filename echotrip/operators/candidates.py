"""Fan-out of prompts, batch translation, two-level rollouts, regrouping."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrip.functions.text import cut_completion
from echotrip.operators import batches
from echotrip.operators.prompts import backward_prompt, forward_prompt
from echotrip.session import shuffles_dropped, spread, stage, staged

# Decoding defaults handed to the translator.
MAX_NEW_TOKENS = 256
SAMPLING = {"do_sample": True, "temperature": 0.5, "top_p": 0.9, "top_k": 100}
GREEDY = {"do_sample": False}

# Called once per task; returns translate(prompts, seeds, options) -> texts. A factory in an
# installed module can keep its model for the worker's later tasks with functools.cache.
Factory = Callable[[], Callable[[list[str], list[int], dict[str, Any]], list[str]]]


def fan_out(df: DataFrame, n: int, index: str) -> DataFrame:
    """Each row ``n`` times, numbered 0..n-1 in column ``index`` (no exchange)."""
    return df.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def complete(
    prompts: DataFrame,
    factory: Factory,
    prompt: str,
    out: str,
    seed_keys: list[str],
    seed: int = 0,
    options: dict[str, Any] | None = None,
    stop: str | None = "\n",
    batch_size: int = 64,
    token_budget: int | None = None,
    token_count: batches.Counter = batches.count_words,
    store: str | None = None,
    model_name: str = "",
    rounds: int = 16,
) -> DataFrame:
    """Add column ``out``: one completion per row, cut at ``stop`` and stripped.

    The factory runs once per task; rows arrive as Arrow batches and reach the translator ``batch_size`` at a time or, with
    ``token_budget``, sorted by length in batches of at most so many padded tokens (``operators.batches``). Each row's
    seed depends on ``seed_keys`` and ``seed`` only, so a task that is run again asks for the same samples.

    With ``store``, a folder, completions are kept there under (``model_name``, options, seed, prompt): what is stored is not asked
    again, in this run or a later one, and equal requests are asked once. Greedy requests have no seed, so equal prompts are
    equal requests. New ones are asked in ``rounds`` parts, each written when it is done, so a run that is killed loses one part.
    """
    options = dict(options or GREEDY)
    keyed = prompts.withColumn("_seed", F.abs(F.xxhash64(*seed_keys, F.lit(seed)) % (2**31 - 1)))
    how = (factory, options, batch_size, token_budget, token_count)
    if store is None:
        answered = _ask(keyed, prompt, out, *how)
    else:
        answered = _ask_once(keyed, prompt, out, how, store, model_name, rounds)
    return answered.withColumn(out, cut_completion(F.col(out), stop))


def _ask(keyed: DataFrame, prompt: str, out: str, factory: Factory, options: dict, batch_size: int, token_budget: int | None, token_count) -> DataFrame:
    """``keyed`` without its _seed and with the translator's texts as they are."""
    schema = T.StructType([f for f in keyed.schema.fields if f.name != "_seed"] + [T.StructField(out, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        translate = factory()
        for frame in frames:
            asked, seeds = frame[prompt].tolist(), frame.pop("_seed").tolist()
            texts: list[str | None] = [None] * len(asked)
            if token_budget is None:
                plan = [range(i, min(i + batch_size, len(asked))) for i in range(0, len(asked), batch_size)]
            else:
                plan = batches.plan(token_count(asked), token_budget, batch_size)
            for rows in plan:
                for i, text in zip(rows, translate([asked[i] for i in rows], [seeds[i] for i in rows], options)):
                    texts[i] = text
            yield frame.assign(**{out: texts})

    return keyed.mapInPandas(run, schema)


def request_key(model_name: str, options: dict[str, Any], prompt: Column, seed: Column) -> Column:
    """What a completion depends on, as one digest; without sampling the seed does not count."""
    parts = [F.lit(model_name), F.lit(json.dumps(options, sort_keys=True)), seed if options.get("do_sample") else F.lit(0), prompt]
    return F.sha2(F.to_json(F.struct(*[x.cast("string").alias(f"p{i}") for i, x in enumerate(parts)])), 256)


def _ask_once(keyed: DataFrame, prompt: str, out: str, how: tuple, store: str, model_name: str, rounds: int) -> DataFrame:
    spark, shape = keyed.sparkSession, "key STRING, completion STRING"
    # Digests are stored as digits, and half as long, as bytes, where they are exchanged.
    keyed = keyed.withColumn("_key", F.unhex(request_key(model_name, how[1], F.col(prompt), F.col("_seed"))))
    spark.createDataFrame([], shape).write.mode("ignore").parquet(store)
    requests = keyed.select(F.col("_key").alias("key"), F.col(prompt).alias("asked"), "_seed").dropDuplicates(["key"])
    stored = lambda: spark.read.schema(shape).parquet(store).withColumn("key", F.unhex("key"))
    known = stored().select("key")
    part = F.pmod(F.xxhash64("key"), F.lit(rounds)).alias("part")
    with staged(requests.join(known, "key", "left_anti").select("*", part), "requests") as new:
        for row in new.groupBy("part").count().orderBy("part").collect():  # one row a round
            wanted = spread(new.where(F.col("part") == row["part"]).drop("part"), "key")
            with shuffles_dropped(spark):
                asked = _ask(wanted, "asked", "completion", *how).select(F.lower(F.hex("key")).alias("key"), "completion")
                asked.write.mode("append").option("compression", "zstd").parquet(store)
    # Two runs at once may have stored one request twice; one of the two counts.
    answers = stored().join(requests.select("key"), "key", "left_semi")
    answers = answers.groupBy(F.col("key").alias("_key")).agg(F.min("completion").alias(out))
    return keyed.join(answers, "_key").drop("_key", "_seed")


def sample(
    prompts: DataFrame, factory: Factory, prompt: str, out: str, n: int, index: str,
    seed_keys: list[str], seed: int = 0, **how,
) -> DataFrame:
    """``n`` sampled completions per prompt, numbered in ``index``."""
    options = {**SAMPLING, "max_new_tokens": MAX_NEW_TOKENS, **how.pop("options", {})}
    return complete(
        fan_out(prompts, n, index), factory, prompt, out, [*seed_keys, index], seed, options, **how
    )


def greedy(
    prompts: DataFrame, factory: Factory, prompt: str, out: str, seed_keys: list[str],
    max_new_tokens: int = MAX_NEW_TOKENS, **how,
) -> DataFrame:
    """One greedy completion per prompt, optionally longer than the default."""
    options = {**GREEDY, "max_new_tokens": max_new_tokens, **how.pop("options", {})}
    return complete(prompts, factory, prompt, out, seed_keys, 0, options, **how)


def rollout(
    sentences: DataFrame,
    factory: Factory,
    n_forward: int = 4,
    n_backward: int = 1,
    greedy_backward: bool = False,
    greedy_tokens: int = 2 * MAX_NEW_TOKENS,
    seed: int = 0,
    style: str = "plain",
    model: str | None = None,
    stop: str | None = "\n",
    **how,
) -> DataFrame:
    """``(sent_id, lang, sentence, fwd_idx, fwd_text, bwd_idx, bwd_text)`` for each sentence; ``how`` goes to ``complete``.

    ``n_forward`` sampled translations per sentence; each is translated back ``n_backward`` times,
    or once greedily with a length limit of its own. Both levels are written to the shared folder:
    candidates must not be drawn anew when an executor is lost or a second job reads them. The first level, which the second
    repeats, and requests that are answered are deleted there.
    Sentences are spread by ``sent_id`` first, since model time dwarfs their size.
    """
    model_col = None if model is None else F.lit(model)
    asked = spread(sentences, "sent_id").select(
        "sent_id",
        "lang",
        "lang_name",
        "sentence",
        forward_prompt(F.col("sentence"), F.col("lang_name"), style, model_col).alias("fwd_prompt"),
    )
    first = sample(asked, factory, "fwd_prompt", "fwd_text", n_forward, "fwd_idx", ["sent_id"], seed, stop=stop, **how)
    with staged(first.drop("fwd_prompt"), "forward") as forward:
        # The files of the first level lie spread as its tasks were, so texts are not exchanged again.
        back = forward.withColumn("bwd_prompt", backward_prompt(F.col("fwd_text"), F.col("lang_name"), style, model_col))
        keys = ["sent_id", "fwd_idx"]
        if greedy_backward:
            back = greedy(back, factory, "bwd_prompt", "bwd_text", keys, greedy_tokens, stop=stop, **how)
            back = back.withColumn("bwd_idx", F.lit(0))
        else:
            back = sample(
                back, factory, "bwd_prompt", "bwd_text", n_backward, "bwd_idx", keys, seed + 1, stop=stop, **how
            )
        return stage(
            back.select("sent_id", "lang", "sentence", "fwd_idx", "fwd_text", "bwd_idx", "bwd_text"),
            "rollout",
        )


def _slots(text: Column, index: Column, n: int) -> Column:
    """Array of ``n`` (held, text) slots filled by index; an aggregate of fixed size, combined map-side."""
    return F.array(
        *[F.struct(F.count(F.when(index == k, 1)).alias("held"), F.max(F.when(index == k, text)).alias("text")) for k in range(n)]
    )


def _checked(value: Column, bad: Column, what: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(what))).otherwise(value)


def _texts(slots: Column) -> Column:
    """Texts of the slots that are held, NULL texts included, by index."""
    return F.transform(F.filter(slots, lambda s: s["held"] > 0), lambda s: s["text"])


def _stray(index: str, n: int) -> Column:
    """Number of rows whose index is none of 0 to n - 1."""
    return F.count(F.when(F.coalesce(F.col(index).between(0, n - 1), F.lit(False)), None).otherwise(1))


def regroup(df: DataFrame, keys: list[str], index: str, text: str, n: int, out: str) -> DataFrame:
    """Flat completions to one list per key, ordered by index; ``n`` is the fan-out.

    Uses ``n`` fixed slots rather than a growing list, so memory per key is bounded by the fan-out
    whatever the input holds. NULL texts keep their place. An index that is missing, outside 0 to n - 1 or
    there twice is an error.
    """
    slots = df.groupBy(*keys).agg(_slots(F.col(text), F.col(index), n).alias("_slots"), _stray(index, n).alias("_stray"))
    twice = F.exists("_slots", lambda s: s["held"] > 1)
    whole = _checked(_texts(F.col("_slots")), (F.col("_stray") > 0) | twice, f"{index}: an index is outside 0 to {n - 1} or not unique")
    return slots.select(*keys, whole.alias(out))


def regroup_tree(rollouts: DataFrame, n_forward: int, n_backward: int) -> DataFrame:
    """``(sent_id, fwd_texts, bwd_texts)`` with back-translations nested per forward candidate.

    NULL texts keep their place; indexes outside the fan-out, or pairs of them that are there twice, are an error.
    """
    slots = rollouts.groupBy("sent_id").agg(
        _slots(F.col("fwd_text"), F.col("fwd_idx"), n_forward).alias("_fwd"),
        F.array(*[_slots(F.col("bwd_text"), F.when(F.col("fwd_idx") == k, F.col("bwd_idx")), n_backward) for k in range(n_forward)]).alias("_bwd"),
        _stray("fwd_idx", n_forward).alias("_stray"),
        _stray("bwd_idx", n_backward).alias("_stray_back"),
    )
    twice = F.exists("_bwd", lambda slots: F.exists(slots, lambda s: s["held"] > 1))
    bad = (F.col("_stray") > 0) | (F.col("_stray_back") > 0) | twice
    nested = F.filter(F.transform("_bwd", _texts), lambda texts: F.size(texts) > 0)
    return slots.select(
        "sent_id",
        _checked(_texts(F.col("_fwd")), bad, "rollouts: an index is outside the fan-out or not unique").alias("fwd_texts"),
        nested.alias("bwd_texts"),
    )


def flatten(lists: DataFrame, keys: list[str], texts: str, index: str, out: str) -> DataFrame:
    """Lists back to one row per element with its index."""
    return lists.select(*keys, F.posexplode(texts).alias(index, out))
