"""Cell declustering: weights that undo the crowding of samples.

A sweep lays every point in one cell for each size and origin, by default two hundred.  Points are laid out once instead, in ranges
of the Z-order of their places.  A range holds all points of most of the cells that it meets, so those are summed where the points are;
only cells that cross the border of a range leave their task, and are merged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.scalar import finite
from ..plans.storage import checkpoint, spare_names


@dataclass
class Sweep:
    """Cell sizes and origins to try."""

    sizes: list[float]
    offsets: int = 8
    anisotropy: tuple[float, float] = (1.0, 1.0)
    largest: bool = False

    @staticmethod
    def between(low: float, high: float, cells: int = 24, **more) -> "Sweep":
        """``cells`` + 1 sizes from low to high by repeated addition; one size if ``cells`` is 1."""
        low, high = min(low, high), max(low, high)
        if cells == 1:
            high = low
        step = (high - low) / cells
        sizes, size = [], low - step
        for _ in range(cells + 1):
            size += step
            sizes.append(size)
        return Sweep(sorted(set(sizes)), **more)


def _points(df: DataFrame, axes: dict[str, str], variable: str, keep: list[str]) -> DataFrame:
    z = finite(F.col(axes["z"])) if "z" in axes else F.lit(0.0)
    rows = df.select(*keep, finite(F.col(axes["x"])).alias("__x"), finite(F.col(axes["y"])).alias("__y"), F.coalesce(z, F.lit(0.0)).alias("__z"), finite(F.col(variable)).alias("__v"))
    return rows.where("__x is not null and __y is not null and __v is not null")


def _bounds(points: DataFrame):
    return points.agg(*[f(c).alias(f"{k}{a}") for k, f in (("lo", F.min), ("hi", F.max)) for a, c in (("x", "__x"), ("y", "__y"), ("z", "__z"))], F.avg("__v").alias("mean"), F.count("*").alias("n")).first()


def default_sweep(df: DataFrame, axes: dict[str, str], variable: str, cells: int = 24, **more) -> Sweep:
    """From a hundredth to half of the largest extent."""
    b = _bounds(_points(df, axes, variable, []))
    extent = max((b["hi" + a] - b["lo" + a] for a in "xyz"), default=0) if b["n"] else 0
    return Sweep.between((extent or 1.0) / 100, (extent or 1.0) / 2, cells, **more)


#: Bits of a place along each axis in the Z-order, and the steps that put two free bits behind each of them.
BITS = 21
TOP = (1 << BITS) - 1
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
#: Points of a range, and cells a point up to which a range's cells are kept by place instead of sorted.
RANGE_POINTS, DENSE = 200_000, 4


@dataclass
class _Frame:
    """Bounds of the points and the grid of each size and origin."""

    low: tuple[float, float, float]
    extent: tuple[float, float, float]
    factors: tuple[float, float, float]
    offsets: int

    @staticmethod
    def of(b, sweep: Sweep) -> "_Frame":
        return _Frame(tuple(b["lo" + a] for a in "xyz"), tuple(b["hi" + a] - b["lo" + a] for a in "xyz"), (1.0, *sweep.anisotropy), sweep.offsets)

    def grid(self, axis: int, size: float, k: int) -> tuple[float, float]:
        """(origin, cell length) of origin ``k`` along an axis."""
        s = size * self.factors[axis]
        return self.low[axis] - 0.01 - k * min(s / self.offsets, 0.5 * self.extent[axis]), s

    @property
    def scales(self) -> list[float]:
        """Lengths along the axes that have all places of the Z-order: in proportion to the cells, so that ranges have short borders."""
        longest = max(e / f for e, f in zip(self.extent, self.factors))
        return [(longest * f) or 1.0 for f in self.factors]

    def most(self, axis: int) -> int:
        """The last place of the points along an axis; an axis without extent has one place."""
        return math.floor(min(self.extent[axis] / self.scales[axis], 1.0) * TOP)

    def place(self, axis: int, x: np.ndarray, pad: int) -> np.ndarray:
        """Z-order place along an axis, moved by ``pad`` against rounding.  No point lies beyond ``most``, so a corner there stands at it."""
        most = self.most(axis)
        at = np.floor((x - self.low[axis]) / self.scales[axis] * TOP)
        return np.clip(np.clip(at, -1, most + 1).astype(np.int64) + pad, 0, most)

    def z(self, corners: list[np.ndarray], pad: int) -> np.ndarray:
        out = 0
        for axis, x in enumerate(corners):
            at = self.place(axis, x, pad)
            for shift, mask in SPREAD:
                at = (at | at << shift) & mask
            out = out | at << axis
        return out

    def with_z(self, points: DataFrame, name: str) -> DataFrame:
        """The same for rows of points, in a column of its own; one step at a time, as each uses the one before it twice."""
        steps = {a: F.floor((F.col("__" + a) - F.lit(self.low[i])) / F.lit(self.scales[i]) * F.lit(float(TOP))) for i, a in enumerate("xyz")}
        out = points.withColumns({f"__z{a}": F.least(F.greatest(at, F.lit(0)), F.lit(self.most(i))).cast("long") for i, (a, at) in enumerate(steps.items())})
        for shift, mask in SPREAD:
            out = out.withColumns({f"__z{a}": F.shiftleft(f"__z{a}", shift).bitwiseOR(F.col(f"__z{a}")).bitwiseAND(F.lit(mask)) for a in "xyz"})
        place = F.col("__zx").bitwiseOR(F.shiftleft("__zy", 1)).bitwiseOR(F.shiftleft("__zz", 2))
        return out.withColumn(name, place).drop("__zx", "__zy", "__zz")


@dataclass
class _Cells:
    """Cells of one size and origin in a range: each point's cell, the cells' places along the axes, and which lie in the range as a whole."""

    of: np.ndarray
    places: list[np.ndarray]
    inside: np.ndarray


def _cells(frame: _Frame, points: list[np.ndarray], size: float, k: int, first: int, last: int) -> _Cells:
    grids = [frame.grid(axis, size, k) for axis in range(3)]
    ends = [[int(np.floor((e - origin) / s)) for e in (x.min(), x.max())] for x, (origin, s) in zip(points, grids)]
    spans = [b - a + 1 for a, b in ends]
    # Along an axis on which all points share a cell nothing is computed for each of them.
    steps = [np.floor((x - origin) / s).astype(np.int64) - a if b > a else 0 for x, (origin, s), (a, b) in zip(points, grids, ends)]
    if math.prod(spans) < 2**62:
        key = (steps[0] * spans[1] + steps[1]) * spans[2] + steps[2] + np.zeros(len(points[0]), np.int64)
        if math.prod(spans) <= DENSE * len(key):
            # Cells between the outermost ones are hardly more than the points: those with points are marked, nothing is sorted.
            filled = np.zeros(math.prod(spans), bool)
            filled[key] = True
            cells, of = np.flatnonzero(filled), (np.cumsum(filled) - 1)[key]
        else:
            cells, of = np.unique(key, return_inverse=True)
        found = np.unravel_index(cells, spans)
    else:
        each, of = np.unique(np.stack([c + np.zeros(len(points[0]), np.int64) for c in steps], 1), axis=0, return_inverse=True)
        found = each.T
    places = [c + a for c, (a, _) in zip(found, ends)]
    low = frame.z([origin + c * s for c, (origin, s) in zip(places, grids)], -1)
    high = frame.z([origin + (c + 1) * s for c, (origin, s) in zip(places, grids)], 1)
    # Places grow with every coordinate, so all points of a cell lie between its corners in the Z-order.
    return _Cells(of.reshape(-1), places, (low >= first) & (high <= last))


def _laid(points: DataFrame, frame: _Frame, n: int, range_points: int) -> tuple[DataFrame, int]:
    """Points in ranges of the Z-order, and the number of ranges."""
    parts = max(math.ceil(n / range_points), min(math.ceil(n / 20_000), points.sparkSession.sparkContext.defaultParallelism))
    return frame.with_z(points, "__at").repartitionByRange(parts, "__at"), parts


def _held(batches, columns: int):
    """All points of a range: their columns, which come first, and the first and last place in the Z-order; None if it has none."""
    table = pa.Table.from_batches(batches)
    if not table.num_rows:
        return None
    held = [table.column(c).to_numpy() for c in range(columns)]
    return held, int(held[-1].min()), int(held[-1].max()), table


def curve(df: DataFrame, axes: dict[str, str], variable: str, sweep: Sweep, range_points: int = RANGE_POINTS) -> DataFrame:
    """(size, mean): declustered mean at every cell size, and the naive mean at size 0.

    A point weighs one over its cell's count and the number of filled cells, so a size's mean is the mean over
    offsets of the mean of cell means.  Points of one place are summed first.  Rows that are shuffled are the points, once, and for each size
    and origin the cells on the borders of ranges.
    """
    points = _points(df, axes, variable, [])
    b = _bounds(points)
    naive = df.sparkSession.createDataFrame([(0.0, b["mean"])], "size double, mean double")
    if (b["n"] or 0) < 2:
        return naive
    frame, sizes = _Frame.of(b, sweep), [float(s) for s in sweep.sizes]
    summed = points.groupBy("__x", "__y", "__z").agg(F.sum("__v").alias("__v"), F.count("*").cast("double").alias("__n"))
    laid, parts = _laid(summed, frame, b["n"], range_points)
    names = ["i", "k", "cx", "cy", "cz", "v", "n"]

    def run(batches):
        held = _held(list(batches), 6)
        if held is None:
            return
        (x, y, z, v, n, _), first, last, _ = held
        first, last = (first, last) if parts > 1 else (0, (1 << 63) - 1)
        own = []
        for i, size in enumerate(sizes):
            for k in range(frame.offsets):
                c = _cells(frame, [x, y, z], size, k, first, last)
                sums, counts = np.bincount(c.of, v), np.bincount(c.of, n)
                own.append((i, k, (sums[c.inside] / counts[c.inside]).sum(), c.inside.sum()))
                out = ~c.inside
                if out.any():
                    some = int(out.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(some, i, np.int32)), pa.array(np.full(some, k, np.int32)), *[pa.array(p[out]) for p in c.places], pa.array(sums[out]), pa.array(counts[out])], names=names)
        i, k, v, n = zip(*own)
        none = pa.nulls(len(own), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, pa.int32()), none, none, none, pa.array(v, pa.float64()), pa.array(n, pa.float64())], names=names)

    # Only what ranges give is written, not the points.  Rows without a cell hold the sum of the means of whole cells and their number.
    found = checkpoint(laid.select("__x", "__y", "__z", "__v", "__n", "__at").mapInArrow(run, "i int, k int, cx long, cy long, cz long, v double, n double"))
    cells = found.groupBy("i", "k", "cx", "cy", "cz").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    whole = F.col("cx").isNull()
    each = cells.groupBy("i", "k").agg((F.sum(F.when(whole, F.col("v")).otherwise(F.col("v") / F.col("n"))) / F.sum(F.when(whole, F.col("n")).otherwise(1.0))).alias("m"))
    per = each.groupBy("i").agg(F.avg("m").alias("mean"))
    return naive.unionByName(per.select(F.get(F.array(*[F.lit(s) for s in sizes]), F.col("i")).alias("size"), "mean"))


def best_size(curve_points: DataFrame, largest: bool = False) -> float:
    """Size of the least (or largest) mean; 0 where no size beats the naive mean; ties go to the smaller size."""
    order = F.desc("mean") if largest else F.asc("mean")
    row = curve_points.where("mean is not null").orderBy(order, "size").first()
    return row["size"] if row else 0.0


def weights(df: DataFrame, axes: dict[str, str], variable: str, sweep: Sweep, row_id: str, pinned: float | None = None, range_points: int = RANGE_POINTS) -> DataFrame:
    """(row_id, weight) with mean 1, at the best size of the sweep or at a pinned one; rows without a place or value get none.

    In every range a point's share is summed over the origins whose cells lie in the range; only points in cells on borders are joined with
    those cells' counts.
    """
    points = _points(df, axes, variable, [row_id])
    b = _bounds(points)
    size = pinned if pinned is not None else (sweep.sizes[0] if len(sweep.sizes) == 1 else best_size(curve(df, axes, variable, sweep, range_points), sweep.largest))
    if not size or (b["n"] or 0) < 2:
        return points.select(row_id, F.lit(1.0).alias("weight"))
    frame, size = _Frame.of(b, sweep), float(size)
    laid, parts = _laid(points.drop("__v"), frame, b["n"], range_points)
    cell = ["k", "cx", "cy", "cz"]
    places = checkpoint(laid.select("__x", "__y", "__z", "__at", row_id))

    def each(batches):
        held = _held(list(batches), 4)
        if held is not None:
            (x, y, z, _), first, last, table = held
            first, last = (first, last) if parts > 1 else (0, (1 << 63) - 1)
            for k in range(frame.offsets):
                yield k, _cells(frame, [x, y, z], size, k, first, last), table

    def count(batches):
        for k, c, _ in each(batches):
            out, n = ~c.inside, np.bincount(c.of)
            some = int(out.sum())
            whole = [pa.array([k], pa.int32()), *[pa.nulls(1, pa.int64())] * 3, pa.array([int(c.inside.sum())])]
            yield pa.RecordBatch.from_arrays(whole, names=[*cell, "n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some, k, np.int32)), *[pa.array(p[out]) for p in c.places], pa.array(n[out])], names=[*cell, "n"])

    # Rows without a cell hold the number of a range's whole cells.
    counted = checkpoint(places.mapInArrow(count, "k int, cx long, cy long, cz long, n long").groupBy(*cell).agg(F.sum("n").alias("n")))
    filled = counted.groupBy("k").agg(F.sum(F.when(F.col("cx").isNull(), F.col("n")).otherwise(1)).alias("cells")).collect()  # a row per origin
    borders = counted.where("cx is not null")
    cells = {r["k"]: r["cells"] for r in filled}
    (share,) = spare_names(points, "share")
    double = StructType.fromDDL("s double")[0].dataType

    # The points are read once for each of the two kinds of shares, which costs less than to write them with their shares.
    def own(batches):
        total = None
        for k, c, table in each(batches):
            ids = table.column(4).combine_chunks()
            total = np.zeros(len(ids)) if total is None else total
            n = np.bincount(c.of)
            total += np.where(c.inside, 1.0 / n / cells[k], 0.0)[c.of]
        if total is not None:
            yield pa.RecordBatch.from_arrays([ids, pa.array(total)], names=[row_id, share])

    def crossings(batches):
        for k, c, table in each(batches):
            ids = table.column(4).combine_chunks()
            out = np.flatnonzero(~c.inside[c.of])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(out)), pa.array(np.full(len(out), k, np.int32)), *[pa.array(p[c.of[out]]) for p in c.places]], names=[row_id, *cell])

    of = F.get(F.array(*[F.lit(float(cells.get(k, 1))) for k in range(frame.offsets)]), F.col("k"))
    field = StructField(row_id, points.schema[row_id].dataType)
    on_borders = places.mapInArrow(crossings, StructType([field, *StructType.fromDDL("k int, cx long, cy long, cz long").fields]))
    crossing = on_borders.join(borders, cell).select(row_id, (1.0 / F.col("n") / of).alias(share))
    shares = places.mapInArrow(own, StructType([field, StructField(share, double)])).unionByName(crossing)
    return shares.groupBy(row_id).agg((F.sum(share) * F.lit(b["n"] / frame.offsets)).alias("weight"))
