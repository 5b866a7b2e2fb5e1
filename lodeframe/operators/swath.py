"""Swath profiles: binned means along axes or directions, with comparison datasets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite
from .statistics import step_percentiles, valid_weight, value_of

#: A direction: the column it runs along, or the components of a unit vector over (x, y, z) columns.
Direction = str | tuple[float, float, float]


def rotated_frame(azimuth: float, dip: float, rake: float) -> dict[str, tuple[float, float, float]]:
    """Unit vectors u, v, w of a plane given by dip direction, dip and rake in degrees; w is its pole."""
    a, d, r = (math.radians(x) for x in (azimuth, dip, rake))
    strike = (-math.cos(a), math.sin(a), 0.0)
    down = (math.sin(a) * math.cos(d), math.cos(a) * math.cos(d), -math.sin(d))
    w = (math.sin(a) * math.sin(d), math.cos(a) * math.sin(d), math.cos(d))
    u = tuple(s * math.cos(r) + t * math.sin(r) for s, t in zip(strike, down))
    v = (w[1] * u[2] - w[2] * u[1], w[2] * u[0] - w[0] * u[2], w[0] * u[1] - w[1] * u[0])
    return {"u": u, "v": v, "w": w}


def along(direction: Direction, axes: tuple[str, str, str]) -> Column:
    """Coordinate of a row along a direction; only components over 1e-12 need a finite coordinate."""
    if isinstance(direction, str):
        return finite(F.col(direction))
    parts = [finite(F.col(c)) * F.lit(float(k)) for k, c in zip(direction, axes) if abs(k) > 1e-12]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def profile(df: DataFrame, variables: list[str], directions: dict[str, tuple[Direction, float]], axes: tuple[str, str, str] = ("x", "y", "z"), weight: str | None = None) -> DataFrame:
    """(direction, bin, centre, variable, count, mean, std) of every bin with values; directions: name -> (direction, width).

    std is the sample form without a weight (0 for one row) and the population form with one.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("direction"), F.lit(float(w)).alias("width"), F.floor(along(d, axes) / F.lit(float(w))).alias("bin")) for k, (d, w) in directions.items()])
    values = F.array(*[F.struct(F.lit(v).alias("variable"), value_of(v).alias("v")) for v in variables])
    rows = df.select(valid_weight(weight).alias("w"), cells.alias("cells"), values.alias("values")).where("w is not null")
    rows = rows.select("w", F.explode("cells").alias("c"), "values").where("c.bin is not null").select("w", "c", F.explode("values").alias("x")).where("x.v is not null")
    v, w = F.col("x.v"), F.col("w")
    mean = F.sum(w * v) / F.sum(w)
    if weight is None:
        std = F.coalesce(F.stddev_samp("x.v"), F.lit(0.0))
    else:
        std = F.sqrt(F.greatest(F.lit(0.0), F.sum(w * v * v) / F.sum(w) - mean * mean))
    out = rows.groupBy("c.direction", "c.bin", "c.width", "x.variable").agg(F.count("*").alias("count"), mean.alias("mean"), std.alias("std"))
    return out.select("direction", "bin", ((F.col("bin") + 0.5) * F.col("width")).alias("centre"), "variable", "count", "mean", "std")


def percentiles(df: DataFrame, variable: str, direction: Direction, width: float, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9), axes: tuple[str, str, str] = ("x", "y", "z"), weight: str | None = None) -> DataFrame:
    """(bin, q, value): step percentiles of each bin along one direction."""
    rows = df.withColumn("__bin", F.floor(along(direction, axes) / F.lit(float(width)))).where("__bin is not null")
    return step_percentiles(rows, variable, at, weight, "__bin").select(F.col("group").cast("long").alias("bin"), "q", "value")


def compare(primary: DataFrame, other: DataFrame) -> DataFrame:
    """Two profiles side by side: every bin of the primary with the other's count and mean in the same bin, if any.

    Bins are anchored at coordinate zero, so equal bin numbers are equal places.
    """
    keys = ["direction", "bin", "variable"]
    return primary.join(other.select(*keys, F.col("count").alias("other_count"), F.col("mean").alias("other_mean")), keys, "left")
