"""BLEU and chrF (0-100) as expressions over n-gram statistics arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from echotrip.functions.ngrams import ORDERS


def _orders(stats: Column, orders: int) -> list[tuple[Column, Column, Column]]:
    """Hyp n-grams, ref n-grams and matches of each order. Orders are few, so the formulas are written out over them and run as
    compiled code, which functions over arrays do not."""
    return [tuple(F.get(stats, F.lit(n + k * orders)) for k in range(3)) for n in range(orders)]


def _total(values: list[Column], start: Column) -> Column:
    return reduce(lambda a, b: a + b, values, start)


def brevity_penalty(hyp_len: Column, ref_len: Column) -> Column:
    return (
        F.when(hyp_len >= ref_len, F.lit(1.0))
        .when(hyp_len > 0, F.exp(1 - F.try_divide(ref_len, hyp_len)))
        .otherwise(F.lit(0.0))
    )


def bleu_score(stats: Column, effective_order: bool) -> Column:
    """BLEU with exponential smoothing of orders without a match.

    ``effective_order``: average only over the orders the hypothesis is long enough for (sentence
    scores); otherwise such an order makes the score 0 (corpus scores).
    """
    orders = ORDERS["words"]
    cells = _orders(stats, orders)
    unmatched, logs = F.lit(0), []
    for h, _, m in cells:
        # Each order without a match halves the stand-in for its zero count once more.
        unmatched = unmatched + F.when((h > 0) & (m == 0), 1).otherwise(0)
        hits = F.when(m == 0, F.lit(1.0) / F.element_at(F.array(*[F.lit(2.0**k) for k in range(orders + 1)]), unmatched + 1)).otherwise(m.cast("double"))
        logs.append(F.when(h > 0, F.ln(hits * 100 / h)).otherwise(0.0))
    penalty = brevity_penalty(cells[0][0], cells[0][1])
    used = _total([F.when(h > 0, 1).otherwise(0) for h, _, _ in cells], F.lit(0))
    matches = _total([F.when(h > 0, m).otherwise(0) for h, _, m in cells], F.lit(0).cast("bigint"))
    usable = used > 0 if effective_order else used == orders
    mean = F.exp(F.try_divide(_total(logs, F.lit(0.0)), used))
    return F.when(usable & (matches > 0), penalty * mean).otherwise(F.lit(0.0))


def chrf_score(
    char_stats: Column, peeled_stats: Column | None = None, beta: float = 2.0
) -> Column:
    """chrF, or chrF++ when the statistics of peeled words are given."""
    cells = _orders(char_stats, ORDERS["chars"])
    if peeled_stats is not None:
        cells += _orders(peeled_stats, ORDERS["peeled"])
    both = [(h > 0) & (r > 0) for h, r, _ in cells]
    p, q = (_total([F.when(ok, c[2] / c[k]).otherwise(0.0) for ok, c in zip(both, cells)], F.lit(0.0)) for k in (0, 1))
    used = _total([F.when(ok, 1).otherwise(0) for ok in both], F.lit(0))
    # The number of orders cancels out of the harmonic mean except for one factor.
    f = F.try_divide(p * q * (1 + beta**2), (p * beta**2 + q) * used)
    return F.coalesce(f * 100, F.lit(0.0))
