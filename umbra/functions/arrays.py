"""Arrays as columns: naming a value once, and running totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An array has fewer elements than two to the power of this.
DOUBLINGS = 31


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where a lambda inside ``body`` uses it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_totals(values: Column) -> Column:
    """The sums of an array's first 1, 2, 3, ... numbers, in n log n steps: each pass adds what stands twice as far back."""
    def step(back: int) -> Callable[[Column], Column]:
        return lambda totals: F.when(F.size(totals) <= back, totals).otherwise(F.transform(totals, lambda x, i: F.when(i >= back, x + F.get(totals, i - back)).otherwise(x)))

    out = values
    for k in range(DOUBLINGS):
        out = let(out, step(1 << k))
    return out
