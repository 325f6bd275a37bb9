"""First rows of a large table in a given order, without passing many rows to one task."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrip.operators.numbering import index_rows
from echotrip.session import shuffle_partitions

IN_ONE_TASK = 100_000  # rows an ordered limit may bring to one task
SAMPLE = 20_000  # keys drawn to guess a bound


def prefix_bound(ids: DataFrame, column: str, wanted: int, buckets: int = 1000) -> int:
    """A value such that at least ``wanted`` rows are not above it, close to the smallest such.

    Reads only the one integer column. Counts per equal-width bucket come back (at most
    ``buckets`` rows), and the bucket the bound falls into is cut again while it holds far more
    rows than wanted.
    """
    value = F.col(column)
    wide = value.cast("decimal(38,0)")  # ids may lie further apart than 2^63
    low, high = ids.agg(F.min(value), F.max(value)).first()
    before = 0
    while True:
        width = (high - low) // buckets + 1
        counts = (
            ids.where(value.between(low, high))
            .groupBy(F.floor((wide - F.lit(str(low)).cast("decimal(38,0)")) / F.lit(str(width)).cast("decimal(38,0)")).alias("b"))
            .count()
            .orderBy("b")
            .collect()
        )
        for bucket, count in ((int(b), c) for b, c in counts):
            if before + count >= wanted:
                break
            before += count
        else:
            return high
        last = min(low + (bucket + 1) * width - 1, high)
        if count <= 4 * wanted or width == 1:
            return last
        low, high = low + bucket * width, last


def key_bound(keys: DataFrame, order: list[str], wanted: int, sample: int = SAMPLE) -> list | None:
    """A key, one value per column of ``order``, such that at least ``wanted`` rows are not above it.

    Guessed from a small sample of the keys and then checked by an exact count, with a higher one tried while there are
    too few. ``None`` if ``wanted`` is so large a part of all rows that no bound helps. Keys are strings, numbers, dates: anything with an order.
    """
    total = keys.count()
    share = min(1.0, sample / max(total, 1))
    if share == 1.0:
        return None
    drawn = keys.select(*order).sample(share, seed=17)
    place = int(wanted * share + 4 * sqrt(wanted * share) + 8)
    while place < sample:
        top = drawn.orderBy(*order).limit(place).agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("key")).first()
        if top.n < place:
            return None
        bound = list(top.key)
        if not_above(keys, order, bound).count() >= wanted:
            return bound
        place *= 2
    return None


def not_above(df: DataFrame, order: list[str], bound: list) -> DataFrame:
    """Rows whose key is not above ``bound``. The condition on the first column alone can reach the scan."""
    kinds = [df.schema[c].dataType for c in order]
    literals = [F.lit(v).cast(kind) for v, kind in zip(bound, kinds)]
    first = F.col(order[0]).isNull() if bound[0] is None else F.col(order[0]).isNull() | (F.col(order[0]) <= literals[0])
    named = F.struct(*[x.alias(c) for x, c in zip(literals, order)])
    return df.where(first).where(F.struct(*order) <= named) if len(order) > 1 else df.where(first)


def cut_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows by ``order``, for a table that holds few more. Up to ``IN_ONE_TASK`` rows by an ordered limit; more stay in the
    partitions where a range partitioning puts them, are cut by their running number and come out sorted by it."""
    if n <= IN_ONE_TASK:
        return df.orderBy(*order).limit(n)
    placed = index_rows(df, order, "_place").where(F.col("_place") < n)
    # A fixed number of ranges: a plain sort of a small result would be folded into one task.
    return placed.repartitionByRange(shuffle_partitions(df.sparkSession), "_place").sortWithinPartitions("_place").drop("_place")


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows by ``order``, of any ordered columns. NULLs come first, as in any ordered limit.

    A plain ordered limit sends up to ``n`` rows of every task to one task. Here rows beyond a bound on the key are filtered out
    first: an exact one if the first column is an integer (pushed down to the scan), else one from a sample, checked by a
    count. So about as many rows as wanted are left to sort.
    """
    if isinstance(df.schema[order[0]].dataType, T.IntegralType):
        top = df.agg(F.max(order[0])).first()[0]
        if top is not None:
            bound = prefix_bound(df.select(order[0]), order[0], n)
            df = df.where(F.col(order[0]).isNull() | (F.col(order[0]) <= bound))
    if n > IN_ONE_TASK or not isinstance(df.schema[order[0]].dataType, T.IntegralType):
        key = key_bound(df.select(*order), order, n)
        if key is not None:
            df = not_above(df, order, key)
    return cut_rows(df, order, n)
