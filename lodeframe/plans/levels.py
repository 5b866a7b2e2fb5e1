"""How many of an ascending list of levels a value passes, by nested comparisons instead of one with every level."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels up to which all comparisons are nested in one expression, whose code stays small enough to be compiled.
NESTED = 8


def levels_passed(levels: Sequence[float], passes: Callable[[Column], Column]) -> Column:
    """Number of leading levels for which ``passes(level)`` holds; it must not hold for a level after one that it fails.

    A short list is searched by halves.  A longer one is cut in about as many runs as a run is long: the run is found among
    the runs' last levels, and only its own levels are counted.  A comparison that is NULL counts as failed.
    """
    if len(levels) <= NESTED:
        return _halved(levels, passes)
    width = math.isqrt(len(levels) - 1) + 1
    runs = [levels[k : k + width] for k in range(0, len(levels), width)]
    run = levels_passed([r[-1] for r in runs], passes)
    own = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in runs], F.array().cast("array<double>")), run + 1)
    return F.least(run * width, F.lit(len(levels))) + F.size(F.filter(own, passes))


def _halved(levels: Sequence[float], passes: Callable[[Column], Column]) -> Column:
    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(passes(F.lit(float(levels[middle]))), between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(levels))
