"""Top-cut diagnostics: what capping high values does to mean, variability and metal."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.levels import levels_passed
from ..plans.prefix import running_totals
from .statistics import quantiles, valid_weight, value_of, weighted_cells


def at_caps(df: DataFrame, variable: str, caps: list[float], weight: str | None = None) -> DataFrame:
    """(cap, n_capped, cap_share, mean, std, cv, metal_removed_pct).

    Rows are summed once by how many caps they exceed; the table per cap is a running total of those few sums.
    """
    caps = sorted(float(c) for c in caps)
    levels = F.array(*[F.lit(c) for c in caps])
    rows = df.select(value_of(variable).alias("v"), valid_weight(weight).alias("w")).where("v is not null and w is not null")
    sums = rows.withColumn("over", levels_passed(caps, lambda c: c < F.col("v"))).groupBy("over")
    sums = sums.agg(F.count("*").alias("k"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("ss"))
    out = sums.select("*", F.posexplode(levels).alias("i", "cap"))
    under = F.col("over") <= F.col("i")
    part = lambda c: F.sum(F.when(under, F.col(c)).otherwise(0))
    out = out.groupBy("cap").agg(part("k").alias("k"), part("w").alias("wk"), part("s").alias("sk"), part("ss").alias("ssk"), F.sum("k").alias("m"), F.sum("w").alias("W"), F.sum("s").alias("sm"))
    c, rest = F.col("cap"), F.col("W") - F.col("wk")
    s, ss = F.col("sk") + rest * c, F.col("ssk") + rest * c * c
    mean = s / F.col("W")
    if weight is None:
        var = F.when(F.col("m") > 1, (ss - s * s / F.col("m")) / (F.col("m") - 1)).otherwise(0.0)
    else:
        var = ss / F.col("W") - mean * mean
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    removed = F.when(F.col("sm") > 0, (F.col("sm") - F.col("sk") - rest * c) / F.col("sm") * 100).otherwise(0.0)
    return out.select("cap", (F.col("m") - F.col("k")).cast("long").alias("n_capped"), (rest / F.col("W")).alias("cap_share"), mean.alias("mean"), std.alias("std"), F.try_divide(std, mean).alias("cv"), removed.alias("metal_removed_pct"))


def suits_log(df: DataFrame, variable: str) -> bool:
    """Whether values are all positive and span a ratio over 50."""
    low, high = df.agg(F.min(value_of(variable)), F.max(value_of(variable))).first()
    return low is not None and low > 0 and high / low > 50


def cap_curve(df: DataFrame, variable: str, points: int = 221, weight: str | None = None) -> DataFrame:
    """``at_caps`` at equally spaced caps from the median to the largest value."""
    low = quantiles(df, variable, (0.5,), weight).first()
    if low is None:
        return at_caps(df.limit(0), variable, [0.0], weight)
    high = df.agg(F.max(value_of(variable))).first()[0]
    return at_caps(df, variable, sorted({low["value"] + (high - low["value"]) * k / (points - 1) for k in range(points)}), weight)


def histogram(df: DataFrame, variable: str, n_bins: int = 50, log: bool = False, weight: str | None = None) -> DataFrame:
    """(bin, low, high, n, w) of equal bins, of logarithms if ``log``; empty bins are left out."""
    v = value_of(variable)
    scale = F.log10(v) if log else v
    rows = df.select(scale.alias("x"), valid_weight(weight).alias("w")).where("x is not null and w is not null")
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    if low is None:
        low, high = 0.0, 1.0
    step = (high - low) / n_bins or 1.0
    at = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(step)), F.lit(n_bins - 1)).cast("int")
    edge = lambda k: F.pow(F.lit(10.0), F.lit(low) + k * F.lit(step)) if log else F.lit(low) + k * F.lit(step)
    out = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    return out.select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "n", "w")


def probability_plot(df: DataFrame, variable: str, weight: str | None = None) -> DataFrame:
    """(value, p): share of weight below each distinct value plus half its own."""
    cells = running_totals(weighted_cells(df, variable, weight), [], "value", "c")
    return cells.select("value", ((F.col("cum") - F.col("c") / 2) / F.col("total")).alias("p"))


def suggest_caps(df: DataFrame, variable: str, at: tuple[float, ...] = (0.9, 0.95, 0.975, 0.99), weight: str | None = None) -> list[float]:
    """Upper quantiles as caps to look at first."""
    return [r["value"] for r in quantiles(df, variable, at, weight).orderBy("q").collect() if r["value"] is not None and math.isfinite(r["value"])]
