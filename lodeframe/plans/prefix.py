"""Running totals over an ordered value that no single task has to see whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import SMALL_ROWS, small

BUCKETS = 64


def running_totals(cells: DataFrame, keys: list[str], value: str, amount: str, buckets: int = BUCKETS) -> DataFrame:
    """cells, one row per (keys, value) -> the same rows with cum, total, prev_value, prev_amount and last.

    cum sums ``amount`` up to and including the row in order of ``value`` within ``keys``; total is the sum over all; last marks
    the largest value.  The values of a key are cut at approximate percentiles; whichever cuts come out, the result is exact,
    because every bucket's total is added to the running sums of the buckets after it.  One bucket is one
    window partition, so even a key that holds all rows is spread over ``buckets`` tasks.  The cuts of few keys are sent
    to all tasks; those of many are joined by a shuffle.
    """
    shares = [k / buckets for k in range(1, buckets)]
    cuts = cells.groupBy(*keys).agg(F.percentile_approx(value, shares, 1000).alias("__cuts"))
    few = True
    if keys:
        same = None
        held = small(cuts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__cuts"), SMALL_ROWS // buckets)
        few = held.limit(SMALL_ROWS // buckets + 1).count() <= SMALL_ROWS // buckets
        for k in keys:
            eq = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
            same = eq if same is None else same & eq
        placed = cells.join(held, same).drop(*[f"__k_{k}" for k in keys])
    else:
        placed = cells.crossJoin(F.broadcast(cuts))  # one row
    placed = placed.withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    sums = placed.groupBy(*keys, "__b").agg(F.sum(amount).alias("__sum"), F.max(F.struct(F.col(value).alias("v"), F.col(amount).alias("a"))).alias("__last"))
    by, all_of = Window.partitionBy(*keys).orderBy("__b"), Window.partitionBy(*keys)
    sums = sums.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__b").alias("__kb"),
        F.coalesce(F.sum("__sum").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"),
        F.sum("__sum").over(all_of).alias("total"),
        F.lag("__last").over(by).alias("__prev"),
        (F.max("__b").over(all_of) == F.col("__b")).alias("__end"),
    )
    same = F.col("__b") == F.col("__kb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    placed = placed.join(F.broadcast(sums) if few else sums, same).drop("__kb", *[f"__k_{k}" for k in keys])  # at most ``buckets`` rows a key
    inside = Window.partitionBy(*keys, "__b").orderBy(value)
    first = F.row_number().over(inside) == 1
    return placed.select(
        *[c for c in cells.columns],
        (F.col("__before") + F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("cum"),
        "total",
        F.when(first, F.col("__prev.v")).otherwise(F.lag(value).over(inside)).alias("prev_value"),
        F.when(first, F.col("__prev.a")).otherwise(F.lag(amount).over(inside)).alias("prev_amount"),
        (F.col("__end") & F.lead(value).over(inside).isNull()).alias("last"),
    )
