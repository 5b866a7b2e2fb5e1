"""Near-duplicate embeddings by NN-descent: a neighbour graph refined through the neighbours of neighbours.

Every point starts with a list of the best among a few that share a hash of random hyperplanes or of its number.  Then the
members of a point's list, and the points in whose lists it stands, meet each other: whoever is nearer than the worst of the other's
list enters it.  Only pairs with a new entry meet again, until hardly any list changes.  Lists are as long as the search needs; one that is
full of links is enlarged, and beyond ``longest`` all of the point's component is compared in blocks, so no number of
partners is too large.  Links are checked in double precision.  At the end the links of a few points are counted in one scan of
all; where too few of them were found, a further round begins with new hyperplanes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.text import with_row_id
from .common import NO_ID, checkpoint, drop_stored, mix64, small, stored
from .components import connected_components

SCHEMA = "vec_id long, n_links long, component_id long, kept boolean, recall double"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(values: list, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """[i, j) of equal neighbouring rows of keys."""
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else np.zeros(0, int)
    return list(zip(new.tolist(), [*new[1:].tolist(), len(keys)]))


def _usable(vectors: DataFrame, column: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, label, v) that can link, and (id) of those that cannot."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(label).isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(column).alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    zero = F.lit(0).cast("float" if dict(vectors.dtypes)[column] == "array<float>" else "double")
    # Adding zero turns -0.0 into 0.0, so that equal vectors have one form.
    return rows.where("fine").select("vec_id", "label", F.transform("v", lambda x: x + zero).alias("v")), rows.where("not fine").select("vec_id")


def _points(rows: DataFrame) -> DataFrame:
    """One point per label and vector: (point, g, size, first, copies, label, v, x, code), numbered in order of their smallest id.

    x holds the vector's doubles, code its direction in half precision, g the number of (label, length) and size its points.
    """
    alone = rows.groupBy("label", "v").agg(F.coalesce(F.min("vec_id"), F.lit(NO_ID)).alias("first"), F.count("*").alias("copies"))
    alone = with_row_id(alone.withColumn("d", F.size("v")), ["first"], "point")
    groups = small(alone.groupBy("label", "d").agg(F.count("*").alias("size")).withColumn("g", F.monotonically_increasing_id()))
    alone = alone.join(groups, ["label", "d"]).select("point", "g", "size", "first", "copies", "label", "v")

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column(6)
                ends = np.cumsum(column.value_lengths().to_numpy())
                x = np.split(column.flatten().to_numpy(zero_copy_only=False).astype(float), ends[:-1])
                code = [_unit(v[None]).astype(np.float16).tobytes() for v in x]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.tobytes() for v in x], pa.binary()), pa.array(code, pa.binary())], names=[*batch.schema.names, "x", "code"])

    return stored(alone.mapInArrow(coded, T.StructType([*alone.schema, T.StructField("x", T.BinaryType()), T.StructField("code", T.BinaryType())])))


def _buckets(points: DataFrame, tables: int, share: int, seed: int) -> DataFrame:
    """(k1, k2, member, fresh, floor, code): points of one label that share the leading bits of a hash, about ``share`` to a bucket.

    The first hash is random, the others are the sides of random hyperplanes.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            point, g, n, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist()
            bits = np.clip(np.ceil(np.log2(np.maximum(n, 1) / share)), 0, 40).astype(np.int64)
            length = np.array([len(c) for c in codes])
            for t in range(tables):
                full = (mix64(point.astype(np.uint64) + np.uint64(seed) * np.uint64(977)) >> np.uint64(24)).astype(np.int64)
                if t:
                    for d in np.unique(length):
                        at = np.flatnonzero(length == d)
                        x = _matrix([codes[i] for i in at], np.float16).astype(np.float32)
                        planes = np.random.default_rng([seed, t, int(d)]).normal(size=(x.shape[1], 40)).astype(np.float32)
                        full[at] = (x @ planes > 0) @ (1 << np.arange(39, -1, -1, dtype=np.int64))
                key = (full >> (40 - bits)) + (t << 48)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(key), pa.array(point), pa.array(np.ones(len(point), bool)), pa.array(np.full(len(point), -2, np.float32)), batch.column(3)], names=["k1", "k2", "member", "fresh", "floor", "code"])

    return points.select("point", "g", "size", "code").mapInArrow(run, "k1 long, k2 long, member long, fresh boolean, floor float, code binary")


def _meet(rows: DataFrame, most: int, meeting: int, seed: int) -> DataFrame:
    """rows(k1, k2, member, fresh, floor, code) -> (v, u, sim): for every member the best of its key that beat its floor.

    Members of a key meet in parts of at most ``meeting``, dealt anew each time by ``seed``; ranges split a key that many have.  Two that
    have met before, neither being fresh, are passed over.
    """
    rows = rows.withColumn("salt", F.xxhash64("member", F.lit(seed))).repartitionByRange("k1", "k2", "salt").sortWithinPartitions("k1", "k2", "salt")

    def part(member, fresh, floor, codes):
        member, first = np.unique(member, return_index=True)
        fresh, floor = fresh[first], floor[first]
        if len(member) < 2 or not fresh.any():
            return None
        x = _matrix([codes[i] for i in first], np.float16).astype(np.float32)
        sim = x @ x.T
        sim[~(fresh[:, None] | fresh[None, :])] = -3
        np.fill_diagonal(sim, -3)
        few = min(most, len(member) - 1)
        near = np.argpartition(sim, len(member) - few, axis=1)[:, len(member) - few :]
        best = np.take_along_axis(sim, near, 1)
        i, j = np.nonzero(best > floor[:, None])
        return member[i], member[near[i, j]], best[i, j]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(), batch.column(5).to_pylist()]
            if held is not None:
                now = [np.concatenate([a, b]) for a, b in zip(held[:4], now[:4])] + [held[4] + now[4]]
            runs, out = _runs(now[0]), []
            for i, j in runs[:-1]:
                out += [part(*(c[k : min(k + meeting, j)] for c in now[1:])) for k in range(i, j, meeting)]
            i, j = runs[-1]
            while j - i > meeting:
                out.append(part(*(c[i : i + meeting] for c in now[1:])))
                i += meeting
            held = [c[i:] for c in now]
            yield from told(out)
        if held is not None:
            yield from told([part(*held[1:])])

    def told(out):
        out = [o for o in out if o is not None]
        if out:
            v, u, sim = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.array(sim)], names=["v", "u", "sim"])

    return rows.select("k1", "k2", "member", "fresh", "floor", "code").mapInArrow(run, "v long, u long, sim float")


def _lists(graph: DataFrame | None, found: DataFrame, lists: int, longest: int, near: float) -> DataFrame:
    """(v, u, sim, fresh, floor): each point's best; a list full of likely links is enlarged, up to ``longest``.

    floor is what a newcomer has to beat.
    """
    both = found.withColumn("fresh", F.lit(True))
    if graph is not None:
        both = both.unionByName(graph.select("v", "u", "sim", F.lit(False).alias("fresh")))
    one = both.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    one = one.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).where(F.col("rank") <= longest)
    one = one.where((F.col("rank") <= lists) | (F.col("sim") >= near))
    mine = Window.partitionBy("v")
    n, last = F.count("*").over(mine), F.min("sim").over(mine)
    full = F.when(n < lists, F.lit(-2.0)).when((last >= near) & (n < longest), F.lit(near)).otherwise(last)
    return stored(one.select("v", "u", "sim", "fresh", full.cast("float").alias("floor")))


def _step(graph: DataFrame, points: DataFrame, lists: int, longest: int, near: float, meeting: int, seed: int) -> DataFrame:
    """One round of neighbours meeting through their common neighbours."""
    hubs = graph.where("fresh").select(F.explode(F.array("v", "u")).alias("k2")).distinct()
    ways = graph.select(F.explode(F.array(F.struct(F.col("v").alias("k2"), F.col("u").alias("member")), F.struct(F.col("u").alias("k2"), F.col("v").alias("member")))).alias("e"), "fresh")
    ways = ways.select("e.*", "fresh").join(hubs, "k2", "left_semi")
    floors = graph.groupBy("v").agg(F.first("floor").alias("floor"))
    nodes = points.select("point", "code").join(floors, F.col("point") == F.col("v"), "left").select(F.col("point").alias("member"), F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor"), "code")
    rows = ways.join(nodes, "member").select(F.lit(0).cast("long").alias("k1"), "k2", "member", "fresh", "floor", "code")
    return _lists(graph, _meet(rows, longest, meeting, seed), lists, longest, near)


def _links(graph: DataFrame, points: DataFrame, threshold: float, near: float) -> DataFrame:
    """(a, b) with a < b: pairs of the lists whose cosine in double precision is ``threshold`` or more."""
    pairs = graph.where(F.col("sim") >= near).select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()
    xs = points.select("point", "x")
    pairs = pairs.join(xs.select(F.col("point").alias("a"), F.col("x").alias("xa")), "a").join(xs.select(F.col("point").alias("b"), F.col("x").alias("xb")), "b")

    def check(batches):
        for batch in batches:
            xa, xb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            size = np.array([[len(v)] for v in xa]).reshape(-1, 1)
            order = np.argsort(size[:, 0], kind="stable")
            for i, j in _runs(size[order]):
                at = order[i:j]
                one, two = _unit(_matrix([xa[k] for k in at], float)), _unit(_matrix([xb[k] for k in at], float))
                good = at[(one * two).sum(1) >= threshold]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good))], names=["a", "b"])

    return stored(pairs.select("a", "b", "xa", "xb").mapInArrow(check, "a long, b long"))


def _linked_in_blocks(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """members(root, point, copies, x) -> (point, links): links of every member within its component, all pairs compared.

    A component is dealt by hash to blocks of about ``block`` points, and every pair of blocks to a task of its own: one block is held, the
    other streams past it, and what leaves the task is a number per point.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(small(sizes), "root").withColumn("own", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("streams"), "point", "copies", "x")
    cells = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "streams")

    def run(batches):
        key, held, x, links = None, [], None, None

        def table():
            point, copies = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            return point, copies, _unit(np.concatenate([h[2] for h in held]))

        def done():
            """What the held block has linked to."""
            nonlocal x, links
            if held and x is None:  # a block with itself
                x = table()
                links = np.zeros(len(x[0]), np.int64)
                for k in range(0, len(links), 256):
                    near = x[2][k : k + 256] @ x[2].T >= threshold
                    near[np.arange(len(near)), np.arange(k, k + len(near))] = False
                    links[k : k + 256] += near @ x[1]
            if held and links.any():
                some = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[0][some]), pa.array(links[some])], names=["point", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], 1)
            point, copies, raw = batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(6).to_pylist()
            for i, j in _runs(keys):
                now, streams = tuple(keys[i, :3]), keys[i, 3]
                if now != key:
                    yield from done()
                    key, held, x, links = now, [], None, None
                if not streams:
                    held.append((point[i:j], copies[i:j], _matrix(raw[i:j], float)))
                    continue
                if x is None:
                    if not held:
                        continue
                    x = table()
                    links = np.zeros(len(x[0]), np.int64)
                near = _unit(_matrix(raw[i:j], float)) @ x[2].T >= threshold
                links += copies[i:j] @ near
                yield pa.RecordBatch.from_arrays([pa.array(point[i:j]), pa.array(near @ x[1])], names=["point", "links"])
        yield from done()

    return cells.mapInArrow(run, "point long, links long").groupBy("point").agg(F.sum("links").alias("links"))


def _audit(points: DataFrame, probes: list, threshold: float) -> DataFrame:
    """(point, truth): number of other vectors that each of a few points links to, counted in one scan of all."""
    by_kind: dict[tuple, list] = {}
    for p in probes:
        by_kind.setdefault((p["g"], len(p["x"])), []).append((p["point"], p["x"]))
    held = {k: (np.array([p for p, _ in v]), _unit(_matrix([x for _, x in v], float))) for k, v in by_kind.items()}

    def scan(batches):
        total = {k: np.zeros(len(v[0]), np.int64) for k, v in held.items()}
        for batch in batches:
            g, copies, x = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist()
            for k, (_, y) in held.items():
                at = np.flatnonzero(g == k[0])
                if len(at):
                    total[k] += copies[at] @ (_unit(_matrix([x[i] for i in at], float)) @ y.T >= threshold)
        for k, v in total.items():
            if v.any():
                yield pa.RecordBatch.from_arrays([pa.array(held[k][0][v > 0]), pa.array(v[v > 0])], names=["point", "truth"])

    found = points.select("point", "g", "copies", "x").mapInArrow(scan, "point long, truth long")
    return found.groupBy("point").agg((F.sum("truth") - 1).alias("truth"))  # less the point itself


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    column: str = "embedding",
    label: str = "label",
    lists: int = 10,
    longest: int = 32,
    tables: int = 6,
    share: int = 16,
    meeting: int = 128,
    settled: float = 0.002,
    steps: int = 12,
    probes: int = 512,
    wanted: float = 0.995,
    rounds: int = 4,
    block: int = 2048,
    seed: int = 13,
) -> DataFrame:
    """vectors(vec_id, column, label) -> (vec_id, n_links, component_id, kept, recall), a row for every row.

    Two vectors link if their labels are equal and not null and their cosine, in double precision, is ``threshold`` or more.  n_links counts the
    other rows that a row links to, equal vectors among them; component_id is the smallest vec_id reachable by links, and kept tells whether it
    is the row's own.  Vectors that are null, zero or hold null or non-finite entries link with nothing; neither do vectors of different
    length.  Ids may repeat: every row is a vector of its own.  A null id is never the smallest; where nothing else is reached, component_id is null
    and the row is kept.  Any magnitude of finite entries counts.  An empty table gives an empty result; further columns are ignored.

    Links that are reported are exact; that all are found rests on the search and is audited: of ``probes`` points, chosen by a hash, all links
    are counted in one scan.  While fewer than ``wanted`` of them were found, another round starts, ``rounds`` at most; ``recall`` is the share at the end.
    A round ends when a step adds less than ``settled`` of the likely links, or after ``steps`` steps.  Lists hold ``lists`` points, or all
    likely links up to ``longest``; where a list is fuller, all members of its component are compared with each other in blocks.

    Equal vectors are one point.  Lists, vectors and links are tables; the driver holds the probes and counts.
    """
    spark = vectors.sparkSession
    if not -1 <= threshold <= 1:
        raise ValueError("threshold is a cosine")
    rows, others = _usable(vectors, column, label)
    points = _points(rows)
    by_hash = points.orderBy(F.xxhash64("point", F.lit(seed)), "point").limit(probes).select("point", "g", "x").collect()
    alone = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not by_hash:
        return alone.withColumn("recall", F.lit(None).cast("double"))
    # Two roundings to half precision and the sum in single precision change a cosine by less than this.
    near = threshold - 0.002 - 2e-7 * max(len(p["x"]) // 8 for p in by_hash)
    truth = checkpoint(_audit(points, by_hash, threshold))

    graph, state, recall = None, None, 0.0
    for turn in range(rounds):
        before, graph = graph, _lists(graph, _meet(_buckets(points, tables, share, seed + turn), longest, meeting, seed + turn), lists, longest, near)
        if before is not None:
            drop_stored(before)
        for step in range(steps):
            fresh = graph.agg(F.count_if("fresh"), F.count_if(F.col("fresh") & (F.col("sim") >= near)), F.count_if(F.col("sim") >= near)).first()
            if not fresh[0] or step and fresh[1] <= settled * fresh[2]:
                break
            before, graph = graph, _step(graph, points, lists, longest, near, meeting, seed + 1000 * (turn + 1) + step)
            drop_stored(before)
        state = _state(graph, points, threshold, near, longest, block)
        told = truth.join(state.select("point", "n_links"), "point", "left").agg(F.sum("truth"), F.sum(F.least("truth", F.coalesce("n_links", F.lit(0))))).first()
        recall = told[1] / told[0] if told[0] else 1.0
        if recall >= wanted:
            break
    keys = points.select("point", "label", "v", "copies", "first").join(state, "point", "left")
    keys = keys.select("label", "v", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), F.nullif(F.coalesce("low", "first"), F.lit(NO_ID)).alias("component_id"))
    linked = rows.join(keys, ["label", "v"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(alone).withColumn("recall", F.lit(recall))


def _state(graph: DataFrame, points: DataFrame, threshold: float, near: float, longest: int, block: int) -> DataFrame:
    """(point, n_links, low) of every point that links with another one; low is the smallest id of its component."""
    links = _links(graph, points, threshold, near)
    roots = connected_components(links)
    ends = checkpoint(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    about = points.select(F.col("point").alias("node"), "copies", "first", "x")
    full = graph.groupBy("v").agg(F.count_if(F.col("sim") >= near).alias("n")).where(F.col("n") >= longest).select(F.col("v").alias("node"))
    dense = checkpoint(ends.join(full, "node", "left_semi").select("root").distinct())
    members = ends.join(dense, "root", "left_semi").join(about, "node").select("root", F.col("node").alias("point"), "copies", "x")
    thin = links.join(ends.withColumnRenamed("node", "a").join(dense, "root", "left_anti").select("a"), "a", "left_semi")
    both = thin.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(F.col("e.a").alias("point"), F.col("e.b").alias("node"))
    few = both.join(points.select(F.col("point").alias("node"), "copies"), "node").groupBy("point").agg(F.sum("copies").alias("links"))
    links_of = few.unionByName(_linked_in_blocks(members, threshold, block))
    firsts = points.select(F.col("point").alias("root"), F.col("first").alias("low"))
    out = ends.withColumnRenamed("node", "point").join(links_of, "point").join(points.select("point", "copies"), "point").join(firsts, "root")
    return stored(out.select("point", (F.col("links") + F.col("copies") - 1).alias("n_links"), "low"))
