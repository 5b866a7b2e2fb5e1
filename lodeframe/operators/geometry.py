"""Grid geometry inferred from coordinates: spacing, origin, sub-blocks and order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..plans.prefix import running_totals
from ..plans.storage import checkpoint

AXIS_SCHEMA = "axis string, origin double, max double, size double, count long, extent double, regularity double, sub_sizes array<double>, sub_count long"
#: Least share of an axis' gaps that makes a gap a block size, and how many explicit sub-block sizes are listed.
LEAST_SHARE, SUB_SIZES = 0.02, 50


def _coordinates(df: DataFrame, axes: dict[str, str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), finite(F.col(c)).alias("v")) for a, c in axes.items()]))
    return df.select(cells.alias("c")).select("c.axis", "c.v").where("v is not null").groupBy("axis", "v").agg(F.count("*").alias("n"))


def spacing(df: DataFrame, axes: dict[str, str], decimals: int = 6) -> DataFrame:
    """(axis, gap, n): how often neighbouring distinct coordinates of an axis lie this far apart, over all rows."""
    return _gaps(df, axes, decimals).where("gap is not null").select("axis", "gap", "n")


def _gaps(df: DataFrame, axes: dict[str, str], decimals: int) -> DataFrame:
    """The same with the least and largest coordinate that have such a gap below them; the first one of an axis has none."""
    cells = running_totals(_coordinates(df, axes), ["axis"], "v", "n")
    gaps = cells.select("axis", "v", F.round(F.col("v") - F.col("prev_value"), decimals).alias("gap"))
    return gaps.groupBy("axis", "gap").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def block_size(gaps: list[tuple[float, int]], total: int | None = None) -> tuple[float | None, list[float]]:
    """Block size and sub-block sizes from a gap histogram, commonest first (ties: the smaller gap).

    Gaps of over 2 % of ``total`` count, the number of all gaps, which may be more than those given.  With several, the largest is the
    parent if at least one other divides it nearly evenly; else the commonest gap is the size.
    """
    if not gaps:
        return None, []
    total = sum(n for _, n in gaps) if total is None else total
    often = [g for g, n in gaps if n > LEAST_SHARE * total]
    if len(often) == 1:
        return often[0], []
    if not often:
        return gaps[0][0], []
    parent = max(often)
    subs = [g for g in often if g < parent and g > 0 and round(parent / g) >= 2 and abs(parent / g - round(parent / g)) <= 0.05]
    return (parent, sorted(subs)) if subs else (gaps[0][0], [])


def axes_geometry(df: DataFrame, axes: dict[str, str], decimals: int = 6, sizes: dict[str, str] | None = None) -> DataFrame:
    """One row per axis: origin, max, size, count, extent, regularity, sub_sizes, sub_count.

    Of the gaps only the commonest and those of over 2 % of all, at most 49, reach the driver, which decides on them.  sizes: axis ->
    column of explicit block sizes, which win: the largest is the block, smaller ones are sub-blocks; sub_sizes lists the largest
    ``SUB_SIZES`` of them, sub_count tells how many there are, and ``explicit_sizes`` has them all.
    """
    spark = df.sparkSession
    held = checkpoint(_gaps(df, axes, decimals))
    gaps = held.where("gap is not null")
    totals = gaps.groupBy("axis").agg(F.sum("n").alias("all"), F.min_by("gap", F.struct(-F.col("n"), "gap")).alias("commonest"))
    often = gaps.join(F.broadcast(totals), "axis").where((F.col("n") > LEAST_SHARE * F.col("all")) | (F.col("gap") == F.col("commonest"))).collect()  # a row an axis
    ends = {r["axis"]: r for r in held.groupBy("axis").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()}
    given = {}
    for axis, column in (sizes or {}).items():
        found = df.select(finite(F.col(column)).alias("d")).where("d > 0").groupBy("d").count()
        top = found.orderBy(F.desc("d")).limit(SUB_SIZES + 1).collect()
        if top:
            given[axis] = (top[0]["d"], sorted(r["d"] for r in top[1:]), found.count() - 1)
    out = []
    for axis in axes:
        if axis not in ends:
            out.append((axis, None, None, None, 0, None, 1.0, [], 0))
            continue
        e, own = ends[axis], sorted((r for r in often if r["axis"] == axis), key=lambda r: (-r["n"], r["gap"]))
        total = own[0]["all"] if own else 0
        size, subs = block_size([(r["gap"], r["n"]) for r in own], total)
        size, subs, n_subs = given.get(axis) or (size, subs, len(subs))
        count = round((e["high"] - e["low"]) / size) + 1 if size else e["n"]
        out.append((axis, e["low"], e["high"], size, count, count * size if size else e["high"] - e["low"], own[0]["n"] / total if own else 1.0, subs, n_subs))
    return spark.createDataFrame(out, AXIS_SCHEMA)


def is_regular(geometry: DataFrame) -> bool:
    """Whether every axis has a size and a commonest gap of at least half of all gaps."""
    return geometry.where("size is null or regularity < 0.5").limit(1).count() == 0


def explicit_sizes(df: DataFrame, column: str) -> DataFrame:
    """(size, n, ratio): positive block sizes of a size column; ratio of the largest to each, rounded."""
    rows = df.select(finite(F.col(column)).alias("size")).where("size > 0").groupBy("size").agg(F.count("*").alias("n"))
    return rows.select("size", "n", F.round(F.max("size").over(Window.partitionBy()) / F.col("size")).cast("long").alias("ratio"))


def loop_order(df: DataFrame, axes: dict[str, str], row_id: str, first_rows: int = 50_000) -> DataFrame:
    """(axis, transitions, place): how often each coordinate changes over the first rows by ``row_id``; the axis that changes most runs fastest."""
    head = df.select(F.col(row_id).alias("__r"), *[finite(F.col(c)).alias(a) for a, c in axes.items()]).orderBy("__r").limit(first_rows)
    by = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    changed = head.select(*[F.coalesce((F.col(a) != F.last(a, ignorenulls=True).over(by)).cast("int"), F.lit(0)).alias(a) for a in axes])
    wide = changed.agg(*[F.sum(a).alias(a) for a in axes])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a), F.lit(0)).cast("long").alias("transitions")) for a in axes])).alias("s")).select("s.*")
    return long.withColumn("place", F.row_number().over(Window.orderBy(F.desc("transitions"), "axis")))
