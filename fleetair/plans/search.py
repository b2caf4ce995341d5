"""Binary search in a sorted array, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_POWERS = [1 << k for k in range(30, -1, -1)]


def count_at_or_below(values: Column, x: Column) -> Column:
    """How many of the ascending ``values`` are at or below ``x``.

    The answer is put together bit by bit, so the cost is the logarithm of the size.
    """
    def step(at: Column, p: Column) -> Column:
        return F.when(F.get(values, at + p - 1) <= x, at + p).otherwise(at)

    return F.aggregate(F.filter(F.lit(_POWERS), lambda p: p <= F.size(values)), F.lit(0), step)
