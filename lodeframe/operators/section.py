"""Slab sections through a model or point set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite

#: Normal axis -> horizontal and vertical axis of the section.
PLANES = {"z": ("x", "y"), "x": ("y", "z"), "y": ("x", "z")}


def slab(df: DataFrame, normal: str, position: float, tolerance: float, axes: dict[str, str], value: str | None = None, sizes: dict[str, str] | None = None) -> DataFrame:
    """(h, v, dh, dv, val) of rows within half the tolerance of the plane, bounds included.

    axes: x, y, z -> column; sizes likewise for block sizes (0 without).  Rows without a finite h or v are left out; val is
    NULL where it is not a number.  Any column can colour the section, calculated ones included.
    """
    h, v = PLANES[normal]
    n = finite(F.col(axes[normal]))
    size = lambda a: F.coalesce(finite(F.col(sizes[a])), F.lit(0.0)) if sizes and a in sizes else F.lit(0.0)
    rows = df.where((n >= position - tolerance / 2) & (n <= position + tolerance / 2))
    val = finite(F.col(value).try_cast("double")) if value else F.lit(None).cast("double")
    return rows.select(finite(F.col(axes[h])).alias("h"), finite(F.col(axes[v])).alias("v"), size(h).alias("dh"), size(v).alias("dv"), val.alias("val")).where("h is not null and v is not null")
