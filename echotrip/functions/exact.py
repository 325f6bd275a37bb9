"""Mean and deviation that do not depend on the order of rows.

A value below ``BOUND`` is split into whole numbers a and b with value = a * 2^-24 + b * 2^-54 (to the nearest 2^-54), and their sums and the
sums of their products are added up as longs. Long sums are exact, so rows may be combined in any order, on any number of tasks or batches of a
stream, and the same values always give the same bits. The deviation is formed from exact differences, so equal parts cancel
without loss. A group that holds larger values, NaN or infinity falls back to the engine's own floating-point moments.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

BOUND = 128.0
A_BITS, B_BITS = 24, 54
# Products are summed as two longs; the low part has so many bits.
LOW = {"aa": 31, "ab": 30, "bb": 29}


def parts(value: str) -> dict[str, Column]:
    """Aggregates of a double column by name; all are sums, counts or extremes, so they combine before the exchange."""
    v = F.col(value)
    inside = F.abs(v) < BOUND  # false for NaN
    a = F.rint(v * 2.0**A_BITS)
    b = F.rint((v - a * 2.0**-A_BITS) * 2.0**B_BITS)
    a, b = (F.when(inside, x.cast("bigint")) for x in (a, b))
    out = {"a": F.sum(a), "b": F.sum(b)}
    for key, product in {"aa": a * a, "ab": a * b, "bb": b * b}.items():
        out[f"{key}_high"] = F.sum(F.shiftright(product, LOW[key]))
        out[f"{key}_low"] = F.sum(product.bitwiseAND(F.lit((1 << LOW[key]) - 1)))
    ends = {"min": F.min(v), "max": F.max(v)}
    return {**out, "count": F.count(v), "inside": F.count(a), **ends, "avg": F.avg(v), "dev": F.stddev_samp(v)}


def sums(value: str, name: str) -> list[Column]:
    """``parts`` as columns ``<name>_<part>``, from which the functions below form moments."""
    return [part.alias(f"{name}_{key}") for key, part in parts(value).items()]


def window_sums(value: str, name: str, over: WindowSpec) -> dict[str, Column]:
    """The same for every row, over the rows of its window."""
    return {f"{name}_{key}": part.over(over) for key, part in parts(value).items()}


def _exact(name: str) -> Column:
    return F.col(f"{name}_inside") == F.col(f"{name}_count")


def total(name: str) -> Column:
    """Sum of the values, from the aggregates ``sums`` gave."""
    whole = F.col(f"{name}_a") * 2.0**-A_BITS + F.col(f"{name}_b") * 2.0**-B_BITS
    return F.when(_exact(name), whole).otherwise(F.col(f"{name}_avg") * F.col(f"{name}_count"))


def mean(name: str) -> Column:
    whole = F.col(f"{name}_a") * 2.0**-A_BITS + F.col(f"{name}_b") * 2.0**-B_BITS
    return F.when(_exact(name), F.try_divide(whole, F.col(f"{name}_count"))).otherwise(F.col(f"{name}_avg"))


def deviation(name: str) -> Column:
    """Sample deviation; NULL for fewer than two values."""
    wide = lambda x: F.col(f"{name}_{x}").cast("decimal(38,0)")
    n = wide("count")

    def spread(key: str, left: str, right: str) -> Column:
        """n * sum of products - product of sums."""
        products = F.try_add(F.try_multiply(wide(f"{key}_high"), F.lit(1 << LOW[key]).cast("decimal(38,0)")), wide(f"{key}_low"))
        gap = F.try_subtract(F.try_multiply(n, products), F.try_multiply(wide(left), wide(right)))
        return gap.cast("double")

    gap = spread("aa", "a", "a") * 2.0 ** (-2 * A_BITS) + spread("ab", "a", "b") * 2.0 ** (1 - A_BITS - B_BITS)
    gap = F.greatest(gap + spread("bb", "b", "b") * 2.0 ** (-2 * B_BITS), F.lit(0.0))
    count = F.col(f"{name}_count").cast("double")
    exact = F.sqrt(F.try_divide(gap, count * (count - 1)))
    # Beyond some 2^30 values a product may pass 38 digits; then, as for large values, the engine's own.
    return F.when(F.col(f"{name}_count") < 2, None).otherwise(F.coalesce(F.when(_exact(name), exact), F.col(f"{name}_dev")))


def moments(values: list[float]) -> tuple[float, float | None]:
    """Mean and sample deviation of a few values within the bound, bit for bit as by the column expressions."""
    a = [round(v * 2.0**A_BITS) for v in values]
    b = [round((v - x * 2.0**-A_BITS) * 2.0**B_BITS) for v, x in zip(values, a)]
    n = len(values)
    average = (sum(a) * 2.0**-A_BITS + sum(b) * 2.0**-B_BITS) / n
    if n < 2:
        return average, None
    spread = lambda x, y: float(n * sum(p * q for p, q in zip(x, y)) - sum(x) * sum(y))
    gap = spread(a, a) * 2.0 ** (-2 * A_BITS) + spread(a, b) * 2.0 ** (1 - A_BITS - B_BITS)
    gap = max(gap + spread(b, b) * 2.0 ** (-2 * B_BITS), 0.0)
    return average, sqrt(gap / (float(n) * (float(n) - 1)))


def group_moments(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``moments`` of groups that lie one after the other and begin at ``starts``, bit for bit; the deviation of one value is NaN."""
    if not np.isfinite(values).all():
        raise ValueError("a value is NaN or infinite")
    sizes = np.diff(starts, append=len(values))
    mean, dev = np.empty(len(starts)), np.full(len(starts), np.nan)
    a = np.rint(values * 2.0**A_BITS)
    wide = lambda x: np.maximum.reduceat(x, starts) - np.minimum.reduceat(x, starts)
    b = np.rint((values - a * 2.0**-A_BITS) * 2.0**B_BITS)
    # A group's gaps are at most (n / 2)^2 products of ranges. Below 2^62 longs hold them, whatever passes 64 bits on the way; others are Python's.
    ranges = np.maximum(wide(a), wide(b)) * sizes / 2
    large = (ranges >= 2.0**31) | (np.maximum.reduceat(np.abs(a), starts) * sizes >= 2.0**62)
    for kind, chosen in ((np.int64, ~large), (object, large)):
        if not chosen.any():
            continue
        rows, n = np.repeat(chosen, sizes), sizes[chosen]
        first = np.cumsum(n) - n
        x, y = (([int(v) for v in part[rows]] if kind is object else part[rows]) for part in (a, b))
        x, y = np.array(x, dtype=kind), np.array(y, dtype=kind)
        sums = lambda part: np.add.reduceat(part, first)
        count = n.astype(np.float64)
        mean[chosen] = (sums(x).astype(np.float64) * 2.0**-A_BITS + sums(y).astype(np.float64) * 2.0**-B_BITS) / count
        x, y = (part - np.repeat(part[first], n) for part in (x, y))  # a gap does not depend on where counting starts
        size = n.astype(kind)
        spread = lambda p, q: (size * sums(p * q) - sums(p) * sums(q)).astype(np.float64)
        gap = spread(x, x) * 2.0 ** (-2 * A_BITS) + spread(x, y) * 2.0 ** (1 - A_BITS - B_BITS)
        gap = np.maximum(gap + spread(y, y) * 2.0 ** (-2 * B_BITS), 0.0)
        dev[chosen] = np.where(n > 1, np.sqrt(gap / np.maximum(count * (count - 1), 1)), np.nan)
    return mean, dev
