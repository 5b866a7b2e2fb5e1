"""Partial states of aggregates that Spark has no built-in for: central moments by weight, and digests of distributions.

Both are made where rows are read, one batch at a time, and merged afterwards.  A state is a row (of moments) or a few rows (of a
digest) that can be kept in a table and merged with those of further data, so nothing that was read has to be read again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import running_totals
from ..plans.storage import checkpoint, small

#: Distinct values up to which a digest is exact, and what the size of its centroids is divided by beyond.
EXACT_VALUES, COMPRESSION = 20_000, 300
#: Groups, and buffered values of a variable, at which a task hands on what it has and starts anew.
MOST_GROUPS, MOST_VALUES = 100_000, 1 << 20
#: Merges of moments take two levels: states are dealt to so many parts first.
PARTS = 64

COUNTS, SUMS = ("count", "nulls", "zeros"), ("w", "m1", "m2", "m3", "m4")


class _Groups:
    """Numbers for the groups that a task has seen."""

    def __init__(self, grouped: bool):
        self.grouped, self.numbers = grouped, {} if grouped else {None: 0}

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        if not self.grouped:
            return np.zeros(batch.num_rows, np.int64)
        coded = batch.column(0).dictionary_encode()
        known = np.array([self.numbers.setdefault(g, len(self.numbers)) for g in coded.dictionary.to_pylist()], np.int64)
        return known[coded.indices.to_numpy()]

    def names(self) -> list:
        return list(self.numbers)


def _merged(a: dict, b: dict) -> dict:
    """Two states of the same groups, by the pairwise formulas for central moments; works on arrays and on columns."""
    w = a["w"] + b["w"]
    if isinstance(w, Column):
        per = lambda x, p: F.coalesce(F.try_divide(x, F.pow(w, F.lit(p)) if p > 1 else w), F.lit(0.0))
    else:
        per = lambda x, p: np.divide(x, w**p, out=np.zeros_like(w), where=w > 0)
    d, both = b["m1"] - a["m1"], a["w"] * b["w"]
    return {
        "w": w,
        "m1": a["m1"] + per(d * b["w"], 1),
        "m2": a["m2"] + b["m2"] + per(d * d * both, 1),
        "m3": a["m3"] + b["m3"] + per(d * d * d * both * (a["w"] - b["w"]), 2) + 3 * per(d * (a["w"] * b["m2"] - b["w"] * a["m2"]), 1),
        "m4": a["m4"] + b["m4"] + per(d * d * d * d * both * (a["w"] * a["w"] - both + b["w"] * b["w"]), 3) + 6 * per(d * d * (a["w"] * a["w"] * b["m2"] + b["w"] * b["w"] * a["m2"]), 2) + 4 * per(d * (a["w"] * b["m3"] - b["w"] * a["m3"]), 1),
    }


def _batch_state(group: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> dict:
    """State of each of ``n`` groups in one batch; deviations are from the batch's own means."""
    known = ~np.isnan(v)
    g, x, u = group[known], v[known], w[known]
    sums = lambda y: np.bincount(g, y, minlength=n).astype(float)
    out = {"count": np.bincount(g, minlength=n), "nulls": np.bincount(group[~known], minlength=n), "zeros": np.bincount(g[x == 0], minlength=n), "w": sums(u)}
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(low, g, x)
    np.maximum.at(high, g, x)
    # About a value of the group first: a sum of large values would lose the digits that the deviations need.
    near = np.where(out["count"] > 0, low, 0.0)
    mean = near + np.divide(sums(u * (x - near[g])), out["w"], out=np.zeros(n), where=out["w"] > 0)
    d = x - mean[g]
    return out | {"min": low, "max": high, "m1": mean, "m2": sums(u * d * d), "m3": sums(u * d * d * d), "m4": sums(u * d * d * d * d)}


def moment_states(rows: DataFrame, variables: list[str], grouped: bool) -> DataFrame:
    """rows([group,] w, one double column per variable) -> (variable, [group,] count, nulls, zeros, w, min, max, m1, m2, m3, m4), a row per task, variable and group.

    m1 is the mean by weight, m2 to m4 the weighted sums of powers of deviations from it.
    """
    first = 2 if grouped else 1
    names = ["variable", "group", *COUNTS, "min", "max", *SUMS]

    def told(groups, states):
        for variable, s in states.items():
            held = groups.names()
            columns = [pa.array([variable] * len(held), pa.string()), pa.array(held, pa.string()), *[pa.array(s[c]) for c in COUNTS], *[pa.array(np.where(np.isfinite(s[c]), s[c], np.nan), from_pandas=True) for c in ("min", "max")], *[pa.array(s[c]) for c in SUMS]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        groups, states = _Groups(grouped), {}
        with np.errstate(all="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                group, w = groups.of(batch), batch.column(first - 1).to_numpy(zero_copy_only=False)
                n = len(groups.numbers)
                for k, variable in enumerate(variables):
                    new = _batch_state(group, batch.column(first + k).to_numpy(zero_copy_only=False), w, n)
                    old = states.get(variable)
                    if old is not None:
                        empty = {"min": np.inf, "max": -np.inf}
                        old = {c: np.concatenate([x, np.full(n - len(x), empty.get(c, 0), x.dtype)]) for c, x in old.items()}
                        new = {**{c: old[c] + new[c] for c in COUNTS}, "min": np.minimum(old["min"], new["min"]), "max": np.maximum(old["max"], new["max"])} | _merged(old, new)
                    states[variable] = new
                if n > MOST_GROUPS:
                    yield from told(groups, states)
                    groups, states = _Groups(grouped), {}
            yield from told(groups, states)

    kinds = ", ".join([*(f"{c} long" for c in COUNTS), "min double", "max double", *(f"{c} double" for c in SUMS)])
    out = rows.mapInArrow(run, f"variable string, group string, {kinds}")
    return out if grouped else out.drop("group")


def merge_moments(states: DataFrame) -> DataFrame:
    """States of the same variables (and groups), however many parts they come from -> one state each.

    Two levels of partial results: states of a group are folded in ``PARTS`` parts first, so no task meets all of them.
    """
    keys = [c for c in ("variable", "group") if c in states.columns]

    def fold(df: DataFrame, by: list[str]) -> DataFrame:
        held = F.sort_array(F.collect_list(F.struct(*SUMS)))  # in one order, so that reruns round alike
        rest = F.slice("s", F.lit(2), F.size("s"))
        merge = lambda a, b: F.struct(*[c.alias(k) for k, c in _merged({k: a[k] for k in SUMS}, {k: b[k] for k in SUMS}).items()])
        out = df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS], F.min("min").alias("min"), F.max("max").alias("max"), held.alias("s"))
        return out.withColumn("s", F.aggregate(rest, F.element_at("s", 1), merge)).select(*by, *COUNTS, "min", "max", "s.*")

    dealt = states.withColumn("__part", F.pmod(F.xxhash64(*SUMS), F.lit(PARTS)))
    return fold(fold(dealt, [*keys, "__part"]), keys)


def _collapsed(g: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells in order of group and value, equal ones as one."""
    order = np.lexsort((v, g))
    g, v, w = g[order], v[order], w[order]
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])) if len(g) else np.zeros(0, np.int64)
    return g[new], v[new], np.add.reduceat(w, new) if len(new) else w


def _centroids(g: np.ndarray, v: np.ndarray, w: np.ndarray, lossy: np.ndarray, compression: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted cells with those of the ``lossy`` groups joined to centroids; the others stay."""
    if not lossy.any():
        return g, v, w
    first = np.concatenate([[True], g[1:] != g[:-1]])
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(g)))
    run = np.cumsum(w)
    before = np.repeat(run[start] - w[start], size)
    total = np.repeat(np.add.reduceat(w, start), size)
    q = np.clip((run - before - w / 2) / total, 1e-15, 1 - 1e-15)
    place = np.floor(compression / 4 * np.log(q / (1 - q)))
    heavy = w >= 4 * total * q * (1 - q) / compression
    alone = heavy | ~lossy[g]
    new = np.flatnonzero(first | alone | np.concatenate([[True], alone[:-1] | (place[1:] != place[:-1])]))
    weight = np.add.reduceat(w, new)
    base = np.repeat(v[new], np.diff(np.append(new, len(v))))
    return g[new], v[new] + np.add.reduceat((v - base) * w, new) / weight, weight


def digest_states(rows: DataFrame, variables: list[str], grouped: bool, exact_values: int = EXACT_VALUES, compression: float = COMPRESSION) -> DataFrame:
    """rows([group,] w, one double column per variable) -> (variable, [group,] mean, weight, exact): each task's digests, not yet merged."""
    first = 2 if grouped else 1
    names = ["variable", "group", "mean", "weight", "exact"]

    def run(batches):
        groups, held, lossy = _Groups(grouped), {v: [[np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]] for v in variables}, {v: np.zeros(0, bool) for v in variables}

        def settle(variable):
            cells = _collapsed(*(np.concatenate(c) for c in zip(*held[variable])))
            n = len(groups.numbers)
            many = np.bincount(cells[0], minlength=n) > exact_values
            lossy[variable] = many | np.concatenate([lossy[variable], np.zeros(n - len(lossy[variable]), bool)])
            held[variable] = [list(_centroids(*cells, lossy[variable], compression))]
            return len(held[variable][0][0])

        def told():
            names_of = np.array(groups.names(), object)
            for variable in variables:
                settle(variable)
                g, v, w = held[variable][0]
                for k in range(0, len(g), 100_000):
                    some = g[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([variable] * len(some), pa.string()), pa.array(names_of[some], pa.string()), pa.array(v[k : k + 100_000]), pa.array(w[k : k + 100_000]), pa.array(~lossy[variable][some])], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            group, w = groups.of(batch), batch.column(first - 1).to_numpy(zero_copy_only=False)
            full = False
            for k, variable in enumerate(variables):
                v = batch.column(first + k).to_numpy(zero_copy_only=False)
                known = ~np.isnan(v)
                held[variable].append([group[known], v[known] + 0.0, w[known]])
                if sum(len(c[0]) for c in held[variable]) > MOST_VALUES:
                    full |= settle(variable) > MOST_VALUES // 2
            if full:  # too many groups to gain by waiting
                yield from told()
                groups, held, lossy = _Groups(grouped), {v: [[np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]] for v in variables}, {v: np.zeros(0, bool) for v in variables}
        yield from told()

    out = rows.mapInArrow(run, "variable string, group string, mean double, weight double, exact boolean")
    return out if grouped else out.drop("group")


def merge_digests(states: DataFrame, exact_values: int = EXACT_VALUES, compression: float = COMPRESSION) -> DataFrame:
    """Digests of parts of the data, as many as there are -> the digest of the whole, of the same form.

    Equal means always become one.  A digest stays exact while its parts are and it has no more than ``exact_values`` of them; then
    neighbours are joined to centroids of a weight of at most 4 W q (1 - q) / ``compression``, W the whole weight and q the share below.
    Running totals give q, so no task has to hold a digest.  The result is written to a checkpoint.
    """
    keys = [c for c in ("variable", "group") if c in states.columns]
    # Written once, as the steps below read it several times and making it means reading the data.
    cells = checkpoint(states.groupBy(*keys, "mean").agg(F.sum("weight").alias("weight"), F.bool_and("exact").alias("exact")))
    about = cells.groupBy(*keys).agg((F.bool_and("exact") & (F.count("*") <= exact_values)).alias("whole"))
    about = small(about.select(*[F.col(k).alias(f"__{k}") for k in keys], "whole"))
    same = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = eq if same is None else same & eq
    marked = cells.drop("exact").join(about, same).select(*keys, "mean", "weight", "whole")
    whole = marked.where("whole").select(*keys, "mean", "weight", F.lit(True).alias("exact"))
    if not about.where("not whole").limit(1).count():
        return whole
    placed = running_totals(marked.where("not whole").drop("whole"), keys, "mean", "weight")
    q = F.least(F.greatest((F.col("cum") - F.col("weight") / 2) / F.col("total"), F.lit(1e-15)), F.lit(1 - 1e-15))
    heavy = F.col("weight") >= 4 * F.col("total") * q * (1 - q) / compression
    placed = placed.withColumn("__place", F.floor(F.lit(compression / 4) * F.log(q / (1 - q)))).withColumn("__own", F.when(heavy, F.col("mean")))
    joined = placed.groupBy(*keys, "__place", "__own").agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("m"), F.sum("weight").alias("weight"))
    return checkpoint(whole.unionByName(joined.select(*keys, F.coalesce("__own", "m").alias("mean"), "weight", F.lit(False).alias("exact"))))
