"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few random directions, shifted, and ordered along a Hilbert curve; this is done for several
curves with directions and shifts of their own.  The orders are range-partitioned by Spark, which gives every vector its exact
place on every curve however many vectors have one key.  A query looks at a window of places around its own on each
curve; what it finds there is ranked by exact distance and the lists of all curves are merged.

How wide the windows must be, and of how many curves, depends on the vectors.  It is measured: the true neighbours of a few
queries are found in one scan, and the cheapest windows that would have caught the wanted share of them are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.text import with_row_id
from .common import checkpoint


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points with ``bits``-bit coordinates (Skilling's transform)."""
    x = [cells[:, k].astype(np.uint64) for k in range(cells.shape[1])]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for k in range(len(x)):
            on = (x[k] & q) > 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & np.uint64(1 << b)) > 0, turn ^ np.uint64((1 << b) - 1), turn)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << one) | (((v ^ turn) >> np.uint64(b)) & one)
    return key


@dataclass
class Curves:
    """Directions, scale and shift of every curve, for vectors divided by 2^exponent."""

    exponent: int
    directions: np.ndarray  # curves x size x dims
    centre: np.ndarray  # curves x dims
    scale: np.ndarray
    shift: np.ndarray
    bits: int

    def keys(self, x: np.ndarray, curve: int) -> tuple[np.ndarray, np.ndarray]:
        """Place on the curve at ``bits`` bits a coordinate, and inside the cell at as many further bits."""
        # Four deviations to each side plus the shift fill the grid; what lies further out is set to its edge.
        with np.errstate(all="ignore"):
            unit = ((np.ldexp(x, -self.exponent) @ self.directions[curve] - self.centre[curve]) / self.scale[curve] + 4) / 9 + self.shift[curve] / 9
        top = 1 << 2 * self.bits
        cell = np.clip(np.nan_to_num(unit * top), 0, top - 1).astype(np.int64)
        return hilbert_keys(cell >> self.bits, self.bits), hilbert_keys(cell & ((1 << self.bits) - 1), self.bits)


def fit(sample: np.ndarray, curves: int = 8, dims: int = 6, bits: int = 10, seed: int = 5) -> Curves:
    rng, size = np.random.default_rng(seed), sample.shape[1]
    dims = min(dims, size)
    directions = np.stack([np.linalg.qr(rng.normal(size=(size, size)))[0][:, :dims] for _ in range(curves)])
    exponent = int(np.frexp(np.abs(sample).max())[1])
    y = np.einsum("ns,csd->cnd", np.ldexp(sample, -exponent), directions)
    return Curves(exponent, directions, y.mean(1), np.maximum(y.std(1), 1e-12), rng.random((curves, dims)), bits)


def windows(apart: np.ndarray, n: int, wanted: float, least: int) -> tuple[int, int]:
    """(curves, reach) of least work that catch ``wanted`` of the pairs; apart: pairs x curves, distances of places.

    A window holds ``reach`` places to either side.  Where the windows would show a query as much as the whole table, one
    window over all of it is taken.
    """
    best = (n, 1, n)
    for c in range(1, apart.shape[1] + 1 if len(apart) else 0):
        near = np.sort(apart[:, :c].min(1))
        reach = max(int(near[min(len(near) - 1, int(np.ceil(wanted * len(near))))]), least)
        best = min(best, (c * (2 * reach + 1), c, reach))
    return best[1], best[2]


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v array<double>) of rows with an id and a finite, non-zero vector of the commonest length."""
    kind = dict(vectors.dtypes)[column]
    v = F.col(column) if kind in ("array<float>", "array<double>") else F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    # Adding zero turns -0.0 into 0.0, so that equal vectors have one form.
    return rows.where(F.size("v") == (common["n"] if common else 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast(kind[6:-1] if kind == "array<float>" else "double")))


def _vectors(column, kind: type) -> np.ndarray:
    """Rows of a binary column of numbers of ``kind`` as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of a to the same of b; differences of any magnitude are scaled by a power of two before they are squared."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = a - b
        largest = np.abs(d).max(1)
        shift = np.where(np.isfinite(largest) & (largest > 0), np.frexp(largest)[1], 0)
        return np.ldexp(np.sqrt((np.ldexp(d, -shift[:, None]) ** 2).sum(1)), shift)


def _closest(queries: np.ndarray, x: np.ndarray, point: np.ndarray, hidden, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, point, distance) of the ``most`` nearest of every query, by exact distance and then by point.

    hidden: None, or a mask queries x points of what a query does not see.

    Inner products rank roughly, on vectors centred and scaled by a power of two; the rounding of a rough distance is bounded, and whatever may
    by that bound be among the nearest is ranked by its exact distance.  So neither an offset nor the magnitude of vectors costs a neighbour.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if not len(queries) or not len(x):
        return none
    exponent = int(np.frexp(max(np.abs(x).max(), np.abs(queries).max()))[1])
    y = np.ldexp(x, -exponent)
    centre = y.mean(0)
    y = y - centre
    length, slack = (y**2).sum(1), 8 * (x.shape[1] + 8) * np.finfo(float).eps
    out, step = [], max(1, min(256, 2_000_000 // len(x)))
    for i in range(0, len(queries), step):
        part = np.ldexp(queries[i : i + step], -exponent) - centre
        own = (part**2).sum(1)[:, None]
        error = slack * (own + length) + 1e-300  # the rest is for squares that vanish
        rough = own + length - 2 * part @ y.T
        seen = np.ones(rough.shape, bool) if hidden is None else ~hidden[i : i + step]
        if most < len(x):
            upper = np.where(seen, rough + error, np.inf)
            bound = np.partition(upper, most - 1, axis=1)[:, most - 1 : most]
            seen &= rough - error <= bound
        q, p = np.nonzero(seen)
        exact = np.concatenate([_distances(queries[i + q[k : k + 50_000]], x[p[k : k + 50_000]]) for k in range(0, len(q), 50_000)]) if len(q) else np.zeros(0)
        order = np.lexsort((point[p], exact, q))
        q, p, exact = q[order], p[order], exact[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < most
        out.append((i + q[first], point[p[first]], exact[first]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _probe(points: DataFrame, probes: list, most: int, kind: type) -> list:
    """(probe number, point) pairs: the true ``most`` nearest others of a few probes(point, x), found in one scan of all points."""
    own, x0 = np.array([p["point"] for p in probes]), np.stack([np.frombuffer(p["x"], kind) for p in probes]).astype(float)

    def scan(batches):
        best = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        for batch in batches:
            if not batch.num_rows:
                continue
            point = batch.column(0).to_numpy()
            new = _closest(x0, _vectors(batch.column(1), kind), point, own[:, None] == point[None, :], most)
            q, p, d = (np.concatenate(c) for c in zip(best, new))
            order = np.lexsort((p, d, q))
            q, p, d = q[order], p[order], d[order]
            first = np.searchsorted(q, q)  # place of each probe's first row
            best = tuple(c[np.arange(len(q)) - first < most] for c in (q, p, d))
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2])], names=["probe", "point", "score"])

    found = points.select("point", "x").mapInArrow(scan, "probe long, point long, score double")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("score", "point"))
    return found.withColumn("place", rank).where(F.col("place") <= most).select("probe", "point").collect()


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    column: str = "embedding",
    curves: int = 8,
    dims: int = 6,
    bits: int = 10,
    wanted: float = 0.95,
    probes: int = 64,
    least_reach: int = 128,
    range_rows: int = 1024,
    cell_queries: int = 4096,
    sample_rows: int = 5000,
    block_bytes: int = 16_000_000,
    seed: int = 5,
) -> DataFrame:
    """vectors(vec_id, column) -> (query_id, rank, vec_id, score): for every row with ``is_query`` the k nearest found among all others.

    The scale of the curves is fitted on at most ``sample_rows`` vectors, and the windows on the true neighbours of at most ``probes``
    queries, both chosen by a hash of the id; every vector is indexed.  ``wanted`` is the share of those neighbours that the windows must
    hold.  Equal vectors are one point with its k + 1 smallest ids, so ties go to the smaller id however many copies there are.
    Score is the Euclidean distance in double precision.  Null, zero, non-finite or odd-sized vectors and rows without an id take
    no part.  An empty table gives an empty result.  Further columns are ignored.

    Every point goes to its range of ``range_rows`` places on each curve, every query to the ranges that its window meets, so rows grow
    with points and with windows.  In a range points are held and queries stream past them; a range that many queries meet is dealt to
    several tasks by the query.  Where no window narrower than the whole table holds the neighbours, every query meets every range: then
    ranges hold up to ``block_bytes`` of vectors, and rows grow with points times queries over the vectors of such a block.
    """
    rows, kind = _usable(vectors, column), np.float32 if dict(vectors.dtypes)[column] == "array<float>" else np.float64
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    points = ranked.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("point", F.element_at("ids", 1))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = checkpoint(queries.join(points.select("v", "point"), "v").select("query_id", "point"))
    wanted_points = asked.select("point").distinct().withColumn("asks", F.lit(True))

    def packed(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), batch.column(2), batch.column(3)], names=["point", "x", "ids", "asks"])

    points = points.join(wanted_points, "point", "left").select("point", "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    points = checkpoint(points.mapInArrow(packed, "point long, x binary, ids array<bigint>, asks boolean"))
    by_hash = points.select("point", "x", "asks").orderBy(F.xxhash64("point"), "point")
    sample = by_hash.limit(sample_rows).select("x").collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(np.stack([np.frombuffer(r["x"], kind) for r in sample]).astype(float), curves, dims, bits, seed)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, asks = _vectors(batch.column(1), kind), batch.column(2)
            for c in range(curves):
                high, low = (pa.array(key.astype(np.int64)) for key in index.keys(x, c))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), high, low, batch.column(0), asks], names=["curve", "high", "low", "point", "asks"])

    n, m = points.agg(F.count("*"), F.sum(F.col("asks").cast("long"))).first()
    places = points.select("point", "x", "asks").mapInArrow(place, "curve int, high long, low long, point long, asks boolean")
    # Curve c holds the row numbers from c * n, so a row's place on its curve is the rest.
    places = with_row_id(places, ["curve", "high", "low", "point"], "at").select("curve", "point", (F.col("at") - F.col("curve") * F.lit(n)).alias("at"))

    chosen = by_hash.where("asks").limit(probes).collect()
    pairs = _probe(points, chosen, k, kind) if chosen else []
    known = sorted({p["point"] for p in chosen} | {p["point"] for p in pairs})
    where = {(r["curve"], r["point"]): r["at"] for r in places.where(F.col("point").isin(known)).collect()}
    apart = np.array([[abs(where[c, chosen[p["probe"]]["point"]] - where[c, p["point"]]) for c in range(curves)] for p in pairs])
    used, reach = windows(apart, n, wanted, least_reach)

    if used * (2 * reach + 1) >= n:
        block = max(range_rows, block_bytes // (8 * len(np.frombuffer(sample[0]["x"], kind))))
        range_rows, cell_queries = max(range_rows, min(block, n // 256)), max(cell_queries, block)
    ranges = -(-n // range_rows)
    cells = max(1, round(m * min(n, range_rows + 2 * reach) / n / cell_queries))
    own = places.where(F.col("curve") < used).join(points.select("point", "x", "asks"), "point")
    cell_of = F.pmod(F.xxhash64("point"), F.lit(cells)).cast("int")
    side = lambda cell, asks, to: own.where(F.col("asks") if asks else F.lit(True)).select("curve", F.explode(to).alias("range"), cell.alias("cell"), F.lit(asks).alias("asks"), "at", "point", "x")
    base = side(F.lit(0), False, F.array((F.col("at") / range_rows).cast("long"))).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    first, last = (F.least(F.greatest(F.floor((F.col("at") + d) / range_rows), F.lit(0)), F.lit(ranges - 1)) for d in (-reach, reach))
    ask = side(cell_of, True, F.sequence(first, last))
    keys = ["curve", "range", "cell"]
    placed = base.unionByName(ask).repartition(*keys).sortWithinPartitions(*keys, "asks")

    def look(batches):
        """Points of a range come before its queries."""
        key, held, x, at, point = None, [], None, None, None
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], 1)
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1) | (asks[1:] != asks[:-1])]))
            for i, j in zip(new, np.append(new[1:], len(asks))):
                part = batch.slice(i, j - i)
                if tuple(group[i]) != key:
                    key, held, x = tuple(group[i]), [], None
                if not asks[i]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if x is None:
                    table = pa.Table.from_batches(held)
                    at, point, x = table.column("at").to_numpy(), table.column("point").to_numpy(), _vectors(table.column("x"), kind)
                q_at, q_point = part.column(4).to_numpy(), part.column(5).to_numpy()
                hidden = np.abs(q_at[:, None] - at[None, :]) > reach
                q, p, d = _closest(_vectors(part.column(6), kind), x, point, hidden if hidden.any() else None, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(q_point[q]), pa.array(p), pa.array(d)], names=["q", "point", "score"])

    found = placed.select(*keys, "asks", "at", "point", "x").mapInArrow(look, "q long, point long, score double")
    found = found.groupBy("q", "point").agg(F.min("score").alias("score"))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("score", "point"))).where(F.col("place") <= k + 1)
    found = found.join(points.select("point", "ids"), "point").select("q", "score", F.explode("ids").alias("vec_id"))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("place") <= k + 1)
    lists = asked.join(found, asked.point == found.q).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
