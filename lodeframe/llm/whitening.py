"""Whitening of embeddings by principal components, from the singular values of the centred rows.

Entries become whole numbers first, so that sums and deviations are exact whatever the order in which tasks add them.  Rows are centred
before anything is multiplied; Spark MLlib's ``computeSVD`` on the distributed centred rows gives the directions, and its singular
values, rescaled by the number of rows, the variances.  The total variance is not their sum: it comes from the exact deviations.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Entries beyond this size are set to it, so that sums and differences of two stay within a long.
LARGEST = 2.0**61


def whole_numbers(vectors: DataFrame, column: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x array<long>) with x = floor(scale * entry) + shift, of rows with a finite vector of the commonest length."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common["n"] if common else 0))
    within = lambda c: F.least(F.greatest(c * F.lit(float(scale)), F.lit(-LARGEST)), F.lit(LARGEST))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(within(c)).cast("long") + F.lit(shift).cast("long")).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def exact_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(rows, sum of every dimension) as Python integers; a task sends on one row per dimension."""

    def partial(batches):
        n, total = 0, [0] * dims
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), dims)
            wide = float(np.abs(x.astype(float)).max()) * len(x) >= 2.0**62
            total = [a + int(b) for a, b in zip(total, (x.astype(object) if wide else x).sum(0))]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims), pa.array([str(t) for t in total])], names=["dim", "n", "total"])

    parts = rows.select("x").mapInArrow(partial, "dim int, n long, total string")
    sums = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return (sums[0]["n"], [int(r["total"]) for r in sums]) if sums else (0, [])


def _row_matrix(rows: DataFrame, column: str) -> RowMatrix:
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias(column)), column)
    return RowMatrix(vectors)


def whiten(vectors: DataFrame, components: int = 8, column: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vectors(vec_id, column) -> (vec_id, component, n, deviation, whitened, explained, identity_error).

    Every remaining vector gives a row for each of the ``components`` directions of largest variance, numbered from 1.  With x the vector in
    whole numbers (``floor(scale * entry) + shift``), n the remaining vectors and S their sums: ``deviation`` is the sum of (n * x - S)^2,
    exact; ``whitened`` the centred x projected on the unit direction, over the square root of its variance; ``explained`` that variance
    over the total one; ``identity_error`` the largest entry by which the covariance of the whitened values differs from the identity.

    Vectors that are null, hold null or non-finite entries or are of another length than most take no part.  Ids may repeat or be null: every
    row is whitened for itself.  There are fewer components where the vectors have fewer dimensions or span fewer, as far as double
    precision tells; vectors that are all equal, and an empty table, give an empty result.  ``deviation`` is null where it exceeds a long,
    and entries beyond 2^61 count as 2^61.  A direction's largest entry is positive, so reruns agree.  Further columns are ignored.

    The driver holds the sums and one matrix of dimensions squared, never rows.  The whole numbers and the projections are written
    once to the shared folder and read by the passes that follow.
    """
    spark = vectors.sparkSession
    rows = stored(whole_numbers(vectors, column, scale, shift))
    first = rows.select(F.size("x").alias("d")).first()
    n, sums = exact_sums(rows, first["d"]) if first else (0, [])
    if not n:
        return spark.createDataFrame([], SCHEMA)
    dims = len(sums)
    # n * x - S = n * (x - base) - rest with small whole numbers, so that nothing is lost where x is far from zero.
    base, rest = [s // n for s in sums], [s % n for s in sums]
    offsets = F.array(*[F.struct(F.lit(b).cast("long").alias("b"), F.lit(r / n).alias("r")) for b, r in zip(base, rest)])
    centred = rows.select(F.zip_with("x", offsets, lambda x, o: (x - o["b"]).cast("double") - o["r"]).alias("c"))
    # Below this share of the largest singular value a direction is rounding only.
    found = _row_matrix(centred, "c").computeSVD(dims, False, math.sqrt(8 * dims * np.finfo(float).eps))
    variance = np.array(found.s) ** 2 / n
    if not len(variance) or not variance[0] > 0:
        return spark.createDataFrame([], SCHEMA)
    used = min(components, len(variance))
    directions = np.array(found.V.toArray())[:, :used]
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(used)])
    variance = variance[:used]
    bases, rests, to_white = np.array(base), np.array(rest), directions / np.sqrt(variance)

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            off = _matrix(batch.column(1), dims) - bases
            white = (off - rests / n) @ to_white
            most = n * (float(np.abs(off.astype(float)).max()) + 1)
            if most * most * dims < 2.0**62:
                exact = ((n * off - rests) ** 2).sum(1).tolist()
            else:
                exact = [int(e) for e in ((n * off.astype(object) - rests) ** 2).sum(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([e if e < 2**63 else None for e in exact], pa.int64()), pa.array([float(e) for e in exact]), pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * used, white.ravel())],
                names=["vec_id", "deviation", "spread", "w"],
            )

    out = stored(rows.select("vec_id", "x").mapInArrow(project, "vec_id long, deviation long, spread double, w array<double>"))
    total = out.agg(F.sum(F.col("deviation").cast("decimal(38,0)")).alias("exact"), F.sum("spread").alias("spread"), F.count_if(F.col("deviation").isNull()).alias("beyond"), *[F.avg(F.get("w", F.lit(k))).alias(f"m{k}") for k in range(used)]).first()
    trace = (float(total["spread"]) if total["beyond"] else float(total["exact"])) / n / n / n
    means = F.array(*[F.lit(total[f"m{k}"]) for k in range(used)])
    again = out.select(F.zip_with("w", means, lambda w, m: w - m).alias("c"))
    covariance = _row_matrix(again, "c").computeGramianMatrix().toArray() / n
    error = float(np.abs(covariance - np.eye(used)).max())
    share = F.array(*[F.lit(float(e / trace)) for e in variance])
    long = out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
