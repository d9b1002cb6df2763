"""The normal distribution as columns: no Python between a test's statistic and its p-value."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series, used up to SPLIT, and of the continued fraction beyond: both are exact to 13 digits there.
TERMS, SPLIT = 60, 2.5


def _held(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, and no generated code for the many terms."""
    return F.element_at(F.transform(F.array(value), body), 1)


def erfc(x: Column) -> Column:
    """The complementary error function of a double."""

    def near(a: Column, square: Column) -> Column:
        series = F.lit(1.0)  # 1 + 2 a^2 / 3 (1 + 2 a^2 / 5 (...)), all terms of one sign
        for n in range(TERMS, 0, -1):
            series = F.lit(1.0) + square * (2.0 / (2 * n + 1)) * series
        return F.lit(1.0) - (2 / math.sqrt(math.pi)) * a * F.exp(-square) * series

    def far(a: Column, square: Column) -> Column:
        tail = a  # 1 / (a + (1/2) / (a + (2/2) / (a + ...)))
        for n in range(TERMS, 0, -1):
            tail = a + F.lit(n / 2) / tail
        return F.exp(-square) / (math.sqrt(math.pi) * tail)

    def both(v: Column) -> Column:
        up = _held(F.abs(v), lambda a: _held(a * a, lambda square: F.when(a < SPLIT, near(a, square)).otherwise(far(a, square))))
        return _held(up, lambda y: F.when(v < 0, 2.0 - y).otherwise(y))

    return _held(x, both)


def rank_test_p(u: Column, n1: Column, n2: Column, tie: Column) -> Column:
    """p that the first sample tends to be larger: normal approximation of U with tie and continuity corrections; 1 if all are equal or one is empty."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    spread = F.sqrt(tie * n1 * n2 * (n1 + n2 + 1) / 12)
    z = F.try_divide(u - n1 * n2 / 2 - 0.5, spread)
    return F.when((tie > 0) & (n1 > 0) & (n2 > 0), 0.5 * erfc(z / math.sqrt(2))).otherwise(1.0)
