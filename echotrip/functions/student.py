"""Student-t tail probability as a column expression: no Python worker, and null in gives null out."""

from __future__ import annotations

from math import log, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half steps of the continued fraction. From one to 1e6 degrees of freedom fewer than 60 whole steps reach full accuracy.
HALF_STEPS = 200
TINY = 1e-300
MANY = 1e6
SHIFT = 20


def _not_zero(x: Column) -> Column:
    return F.when(F.abs(x) > TINY, x).otherwise(F.lit(TINY))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, folded over its half steps (modified Lentz)."""

    def step(held: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        numerator = F.when(k % 2 == 0, even).otherwise(odd)
        d = 1 / _not_zero(1 + numerator * held["d"])
        c = _not_zero(1 + numerator / held["c"])
        return F.struct(c.alias("c"), d.alias("d"), (held["value"] * c * d).alias("value"))

    first = 1 / _not_zero(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("value"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(HALF_STEPS + 1)), start, step, lambda held: held["value"])


def _gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a): the series at a + SHIFT, brought down by the recurrence."""
    tail = lambda v: 1 / (12 * v) - 1 / (360 * v * v * v) + 1 / (1260 * v * v * v * v * v)
    high = a + SHIFT
    series = (high - 0.5) * F.log1p(0.5 / high) + 0.5 * (F.log(high + 0.5) - 1) + tail(high + 0.5) - tail(high)
    down = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(1.0), lambda held, i: held * ((a + i + 0.5) / (a + i)))
    return F.exp(series) / down


def two_sided_p(t: Column, freedom: Column) -> Column:
    """Chance of a t at least so far from 0, for at least one degree of freedom: I_x(freedom / 2, 1/2) with x = freedom / (freedom + t^2)."""
    a, b = freedom.cast("double") / 2, F.lit(0.5)
    square = t * t
    x = 1 / (1 + square / freedom)
    y = F.when(square > 0, 1 / (1 + freedom / _not_zero(square))).otherwise(F.lit(0.0))
    power = F.exp(a * F.when(y < 0.5, F.log1p(-y)).otherwise(F.log(_not_zero(x))))
    front = _gamma_ratio(a) / sqrt(pi) * power * F.sqrt(y)
    low, high = front * _fraction(a, b, x) / a, 1 - front * _fraction(b, a, y) / b
    p = F.when(x < (a + 1) / (a + b + 2), low).otherwise(high)
    # With so many degrees of freedom 1 - x has few digits left; the normal with one correction is right to 1e-12.
    p = F.when(freedom <= MANY, p).when(square > 4000, 0.0).otherwise(normal_p(t * (1 - (square + 1) / (4 * freedom))))
    return F.when(t.isNull() | freedom.isNull() | (freedom < 1), F.lit(None)).when(F.isnan(t), F.lit(float("nan"))).when(square == float("inf"), 0.0).otherwise(p)


def normal_p(z: Column) -> Column:
    """Chance of a standard normal at least so far from 0, by the tail's continued fraction or, near 0, the series of the middle."""
    u = F.abs(z)
    square = F.least(u * u, F.lit(1600.0))  # beyond, the density is 0
    density = F.exp(-square / 2) / sqrt(2 * pi)
    # 1 / (u + 1 / (u + 2 / (u + ...))), from its far end.
    far = F.aggregate(F.sequence(F.lit(120), F.lit(1)), F.lit(0.0), lambda held, k: k / (_not_zero(u) + held))
    term = F.struct(u.alias("sum"), u.alias("term"))

    def grow(held: Column, k: Column) -> Column:
        next_term = held["term"] * square / (2 * k + 1)
        return F.struct((held["sum"] + next_term).alias("sum"), next_term.alias("term"))

    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), term, grow, lambda held: held["sum"])
    return F.when(z.isNull(), F.lit(None)).when(u < 2.5, 1 - 2 * density * near).otherwise(2 * density / (u + far))


# Two-sided 95 % point of the standard normal.
NORMAL_95 = 1.959963984540054
LOG_2_PI = log(2 * pi)
