"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the continued fraction. Between the two forms below 60 are enough for every number of rows.
TERMS = 120
_SHIFT = 8


def _log_gamma_half_step(a: Column) -> Column:
    """ln gamma(a + 1/2) - ln gamma(a): the asymptotic series at a + 8, stepped back by the recurrence."""
    z = a + _SHIFT
    series = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * z**3) - 1 / (640 * z**5) + 17 / (14336 * z**7)
    return series - sum(F.log1p(0.5 / (a + j)) for j in range(_SHIFT))


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, from the front, numerator and denominator as ratios."""

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = F.when(k % 2 == 0, even).otherwise(odd)
        low, high = 1 / (1 + d * s["low"]), 1 + d / s["high"]
        return F.struct((s["value"] * low * high).alias("value"), low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(1.0).alias("value"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return 1 / F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["value"]


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by Student's t with n - 2 degrees of freedom.

    With a = (n - 2) / 2 it is the regularised incomplete beta function of 1 - r^2 at (a, 1/2). Its continued
    fraction converges fast from this side if a r^2 > 3, else from the other side, where it is one minus that
    of r^2 at (1/2, a). Null for n < 3, 0 for a perfect correlation.
    """

    def of(s: Column) -> Column:
        y, a = s["r"] * s["r"], (s["n"] - 2) / 2
        half = F.lit(0.5)
        front = F.exp(a * F.log1p(-y) + F.log(y) / 2 + _log_gamma_half_step(a) - 0.5 * math.log(math.pi))
        direct = front / a * _fraction(1 - y, a, half)
        mirror = 1 - front / half * _fraction(y, half, a)
        return (F.when(s["n"] < 3, None).when(y >= 1.0, 0.0).when(y == 0.0, 1.0).when(a * y > 3, direct).otherwise(mirror))

    # bound to a lambda variable: r is an expression over the whole table and stands in every term
    given = F.array(F.struct(r.cast("double").alias("r"), n.cast("double").alias("n")))
    return F.when(r.isNotNull() & n.isNotNull(), F.get(F.transform(given, of), F.lit(0)))
