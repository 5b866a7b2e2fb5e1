"""Near-duplicate documents: SimHash fingerprints joined by a binary trie.

Fingerprints are the trie's leaves.  Two nodes of one depth are traversed together; the bits in
which their prefixes differ are accumulated and the pair is pruned as soon as they exceed the
Hamming budget.  To spread the traversal over a cluster, the 64 bits are cut into blocks and the
trie is read in several bit orders, each with some blocks first: two fingerprints within the budget
agree on enough whole blocks that in one of the orders they share the top of the trie.  Each such
subtrie is one group of the shuffle, so no pair is lost and none is enumerated across groups.

Identical fingerprints are collapsed before the join and groups only report a spanning forest of
the links found, so thousands of copies cost neither pairs nor rows.  A subtrie larger than
``group_rows`` is cut into cells that meet pairwise in separate groups.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, checkpoint, id_or_null, keyed, mix64, slices, spare_names
from .components import connected_components

SEED = 42
#: Bands of minimum hashes, and hashes in a band.
BANDS, ROWS = 20, 5
_FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _shingles(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of all shingles of a text in order; a text of fewer words is one shingle, one without words has none."""
    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # on bytes: lower-cases A-Z only and splits at the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return np.array([digest(joined[i:j], SEED) for i, j in zip((ends - sizes).tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def _fingerprint_batch(texts: list[bytes], shingle: int) -> np.ndarray:
    """Unsigned fingerprints of whole texts."""
    return _majorities([_shingles(text, shingle) for text in texts])


def _majorities(parts: list[np.ndarray]) -> np.ndarray:
    """A fingerprint for each array of hashes: bit i is set if it is set in over half of them."""
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    out = np.zeros(len(parts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    hashes = np.concatenate(parts)
    # Eight bits at a time are summed in the eight byte lanes of a word, over runs of at most 255 rows.
    starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    runs = (counts[full] + 254) // 255
    first_run = np.concatenate([[0], np.cumsum(runs)[:-1]])
    at = np.repeat(starts - 255 * first_run, runs) + 255 * np.arange(runs.sum())
    lane, fingerprint = np.uint64(0x0101010101010101), np.zeros(len(full), np.uint64)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lane, at).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums.astype(np.int64), first_run, axis=0)
        majority = (2 * total > counts[full, None]).astype(np.uint64)
        for byte in range(8):
            fingerprint |= majority[:, byte] << np.uint64(8 * byte + bit)
    out[full] = fingerprint
    return out


def fingerprints(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """documents(doc_id, text) -> (doc_id long, fp long: the fingerprint's bits as a signed number).

    Null and empty texts have fingerprint zero.  A null id comes back as NO_ID.  Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for i, j in slices(np.fromiter(map(len, texts), np.int64, len(texts)), 2_000_000):
                fp = _fingerprint_batch(texts[i:j], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return keyed(documents).mapInArrow(run, "doc_id long, fp long")


def _different(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes of the different shingles of a text; a text without words has one, zero."""
    hashes = np.unique(hashes)
    return hashes if len(hashes) else np.zeros(1, np.uint64)


def _shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return _different(_shingles(text, shingle))


def _bands(hashes: np.ndarray) -> np.ndarray:
    """A hash for each band of the minimum hashes of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 5_000):
        least = np.minimum(least, (hashes[k : k + 5_000, None] * _FACTORS).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return out


def banded(documents: DataFrame, shingle: int) -> DataFrame:
    """documents(doc_id, text) -> (doc_id long, print long: a hash of the text, fp long: its fingerprint, n int: its different shingles, bands array<long>)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for i, j in slices(np.fromiter(map(len, texts), np.int64, len(texts)), 2_000_000):
                parts = [_shingles(t, shingle) for t in texts[i:j]]
                fp = pa.array(_majorities(parts).view(np.int64))
                sets = [_different(h) for h in parts]
                bands = np.concatenate([_bands(h) for h in sets]).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32)), pa.array(bands))
                n = pa.array(np.fromiter(map(len, sets), np.int32, len(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), fp, n, bands], names=["doc_id", "print", "fp", "n", "bands"])

    return keyed(documents).withColumn("print", F.xxhash64("text")).mapInArrow(run, "doc_id long, print long, fp long, n int, bands array<bigint>")


def _orders(budget: int, rows: int, group_rows: int) -> list[list[tuple[int, int]]]:
    """Bit orders as lists of (shift, width), the shared blocks first; ``len`` of the shared part is blocks - budget.

    With more rows the word is cut finer and more blocks are shared, so that subtries stay near ``group_rows / 10``.
    """
    for blocks in range(budget + 1, budget + 4):
        cuts = np.linspace(64, 0, blocks + 1).astype(int)
        cells = [(int(b), int(a - b)) for a, b in zip(cuts[:-1], cuts[1:])]
        shared = list(combinations(range(blocks), blocks - budget))
        width = min(sum(cells[i][1] for i in pick) for pick in shared)
        if rows / 2.0**width <= group_rows / 10 or blocks == budget + 3:
            return [[cells[i] for i in pick] + [c for i, c in enumerate(cells) if i not in pick] for pick in shared]
    raise AssertionError


def _permuted(values: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for shift, width in order:
        out = (out << np.uint64(width)) | ((values >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def _merge(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Join the sets of linked items; labels always point at a set's smallest item."""
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return labels
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further


def trie_forest(values: np.ndarray, bounds: np.ndarray, depth: int, budget: int, leaf: int = 64, wave: int = 200_000) -> np.ndarray:
    """Labels of a spanning forest of the links within ``budget`` bits among sorted values of several subtries.

    bounds: starts of the subtries and the end; all values of a subtrie share their top ``depth`` bits.
    A trie node is a range of the sorted values; node pairs are held in waves, deepest first, which bounds memory.
    """
    labels, ones = np.arange(len(values)), {}
    lo, hi = bounds[:-1], bounds[1:]
    some = hi - lo > 1
    lo, hi = lo[some], hi[some]
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > wave:
            stack += [(depth, *(x[k : k + wave] for x in (alo, ahi, blo, bhi, err))) for k in range(0, len(alo), wave)]
            continue
        small = ((ahi - alo) * (bhi - blo) <= leaf) | (depth == 64)
        if small.any():
            a0, an, b0, bn = alo[small], (ahi - alo)[small], blo[small], (bhi - blo)[small]
            for i, j in slices(an * bn, 4_000_000):
                size = an[i:j] * bn[i:j]
                k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                width = np.repeat(bn[i:j], size)
                left, right = np.repeat(a0[i:j], size) + k // width, np.repeat(b0[i:j], size) + k % width
                near = (left < right) & (np.bitwise_count(values[left] ^ values[right]) <= budget)
                labels = _merge(labels, left[near], right[near])
        if small.all():
            continue
        alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)])
        amid, bmid = ahi - (ones[depth][ahi] - ones[depth][alo]), bhi - (ones[depth][bhi] - ones[depth][blo])
        twin = alo == blo
        children = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + 1),
            tuple(x[~twin] for x in (amid, ahi, blo, bmid, err + 1)),
        ]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*children))
        live = (alo < ahi) & (blo < bhi) & (err <= budget) & ~((alo == blo) & (ahi - alo == 1))
        stack.append((depth + 1, *(x[live] for x in (alo, ahi, blo, bhi, err))))
    return labels


def hamming_links(points: DataFrame, budget: int = 4, group_rows: int = 20_000) -> DataFrame:
    """points(fp long, rep long), fingerprints distinct -> edges(a, b) that connect what links within ``budget`` connect."""
    orders = _orders(budget, points.count(), group_rows)
    shared = len(orders[0]) - budget
    depths = [sum(w for _, w in o[:shared]) for o in orders]

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for t, order in enumerate(orders):
                value = _permuted(fp, order)
                top = (value >> np.uint64(64 - depths[t])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(top), pa.array(value.view(np.int64)), batch.column(1)], names=["t", "top", "value", "rep"])

    placed = points.select("fp", "rep").mapInArrow(spread, "t int, top long, value long, rep long")
    large = placed.groupBy("t", "top").agg(F.count("*").alias("n")).where(F.col("n") > group_rows)
    cells = F.ceil(2 * F.col("n") / group_rows).cast("int")
    own = F.pmod(F.xxhash64("value"), F.col("cells")).cast("int")
    placed = (
        placed.join(large.select("t", "top", cells.alias("cells")), ["t", "top"], "left")
        .withColumn("cells", F.coalesce("cells", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        .select("t", "top", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "value", "rep")
    )

    def traverse(batches):
        def forest(table):
            t, top, i, j, value, rep = (c.to_numpy() for c in table.columns)
            value = value.view(np.uint64)
            order = np.lexsort((value, j, i, top, t))
            t, top, i, j, value, rep = (x[order] for x in (t, top, i, j, value, rep))
            for table_no in np.unique(t):
                own = np.flatnonzero(t == table_no)
                a, b = own[0], own[-1] + 1
                new = np.concatenate([[True], (np.diff(top[a:b]) != 0) | (np.diff(i[a:b]) != 0) | (np.diff(j[a:b]) != 0)])
                bounds = np.concatenate([np.flatnonzero(new), [b - a]])
                labels = trie_forest(value[a:b], bounds, depths[table_no], budget)
                linked = np.flatnonzero(labels != np.arange(b - a))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[a:b][linked]), pa.array(rep[a:b][labels[linked]])], names=["a", "b"])

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 60_000:
                continue
            table = pa.Table.from_batches(held)
            key = [table.column(c).to_numpy() for c in range(4)]
            last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
            if not len(last):
                continue  # one group so far, at most group_rows of them
            cut = int(last[-1]) + 1
            yield from forest(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from forest(pa.Table.from_batches(held))

    keys = ["t", "top", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(traverse, "a long, b long")


def band_links(texts: DataFrame) -> DataFrame:
    """texts(print, bands) -> edges(a, b): the texts that share a band, each linked to the smallest of them."""
    rows = texts.select("print", F.explode("bands").alias("band"))
    least = checkpoint(rows.groupBy("band").agg(F.min("print").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "low"))
    return rows.join(least, "band").where("print <> low").select(F.col("print").alias("a"), F.col("low").alias("b"))


def trie_links(texts: DataFrame, budget: int, group_rows: int = 20_000) -> DataFrame:
    """texts(print, fp) -> edges(a, b) that connect the texts whose fingerprints the trie join connects, equal ones included."""
    points = checkpoint(texts.groupBy("fp").agg(F.min("print").alias("rep")))
    own = texts.join(points, "fp").where("print <> rep").select(F.col("print").alias("a"), F.col("rep").alias("b"))
    return own.unionByName(hamming_links(points, budget, group_rows))


def _linked(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of all pairs of sets, held as sorted arrays, whose Jaccard similarity reaches ``similarity``.

    Components grow from one set at a time, which is compared with all sets not yet in a component.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.cumsum(sizes) - sizes
    mark, left, edges, queue = np.zeros(int(ids.max()) + 1, bool), np.arange(len(sets)), [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            if not len(left):
                break
            lengths = sizes[left]  # the sets that are left, moved together once for every component
            rest = ids[np.repeat(begin[left] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
        k = queue.pop()
        own = ids[begin[k] : begin[k] + sizes[k]]
        mark[own] = True
        lengths = sizes[left]
        common = np.add.reduceat(mark[rest], np.cumsum(lengths) - lengths, dtype=np.int64)
        mark[own] = False
        # In whole numbers of hundredths of a per cent: 4 of 5 is exactly 0.8.
        near = common * 10_000 >= round(similarity * 10_000) * (sizes[k] + lengths - common)
        if near.any():
            found = left[near].tolist()
            edges += [(k, other) for other in found]
            queue += found
            rest, left = rest[~np.repeat(near, lengths)], left[~near]
    return edges


def jaccard_links(documents: DataFrame, candidates: DataFrame, shingle: int, similarity: float, group_rows: int = 4_000, group_shingles: int = 4_000_000) -> DataFrame:
    """documents(text), candidates(print, root, n) -> edges(a, b) of prints that connect what the exact similarity of shingle sets connects.

    All texts of one root are compared, each once however often it is repeated.  A root of more than ``group_rows`` texts or
    ``group_shingles`` shingles is cut in cells that meet pairwise.
    """
    # Written before it is joined back: between two tables as they lie Spark can split the rows of a large root.
    sizes = checkpoint(candidates.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).where("rows > 1"))
    cells = F.greatest(F.lit(1), F.when(F.col("rows") > group_rows, F.ceil(2 * F.col("rows") / group_rows)), F.when(F.col("shingles") > group_shingles, F.ceil(2 * F.col("shingles") / group_shingles))).cast("int")
    chosen = candidates.join(sizes.select("root", cells.alias("cells")), "root").select("print", "root", "cells")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = documents.select(F.xxhash64(text).alias("print"), text.alias("text")).groupBy("print").agg(F.min("text").alias("text"))
    rows = texts.join(chosen, "print")

    def take(batches):
        for batch in batches:
            sets = [_shingle_set(t, shingle).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), batch.column(2), batch.column(3)], names=["print", "set", "root", "cells"])

    placed = rows.select("print", "text", "root", "cells").mapInArrow(take, "print long, set binary, root long, cells int")
    own = F.pmod(F.xxhash64("print"), F.col("cells")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    placed = placed.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "print", "set")

    def compare(batches):
        def forest(names, sets):
            edges = _linked([np.frombuffer(x, np.uint64) for x in sets], similarity)
            a, b = (pa.array([names[e[k]] for e in edges], pa.int64()) for k in (0, 1))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        key, names, sets = None, [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for root, i, j, name, held in zip(*columns):
                if (root, i, j) != key:
                    if len(names) > 1:
                        yield forest(names, sets)
                    key, names, sets = (root, i, j), [], []
                names.append(name)
                sets.append(held)
        if len(names) > 1:
            yield forest(names, sets)

    keys = ["root", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def _grouped(documents: DataFrame, shingle: int, budget: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp), and groups (fp, root) of fingerprints with the root of their component."""
    prints = checkpoint(fingerprints(documents, shingle))
    points = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # The nodes are fingerprints, not ids: fingerprints whose documents all lack an id stay apart.
    roots = connected_components(hamming_links(points.select("fp", F.col("fp").alias("rep")), budget, group_rows))
    groups = points.join(roots, points.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    return prints, groups


def near_duplicates(documents: DataFrame, shingle: int = 4, budget: int = 4, group_rows: int = 20_000) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, fp long, fingerprint string, component_id) with one row per input row.

    component_id is the smallest doc_id reachable over links of at most ``budget`` differing bits, a
    document's own included.  Nulls: a null text counts as empty, a null id is kept and is nobody's
    smallest id unless its whole component has none, where component_id is null.  Repeated rows share
    their row's result; an empty table gives an empty result; further columns are ignored.
    """
    prints, groups = _grouped(documents, shingle, budget, group_rows)
    # Written before it is joined back: between two tables as they lie Spark can split the rows of a large component.
    smallest = checkpoint(groups.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = groups.join(smallest, "root").select("fp", "component_id")
    out = prints.join(named, "fp")
    return out.select(id_or_null("doc_id").alias("doc_id"), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_or_null("component_id").alias("component_id"))


def keep_one_of_each(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, budget: int = 4) -> DataFrame:
    """The document with the smallest id of every group of similar ones, with all its columns; of repeated rows one stays.

    Documents link if the Jaccard similarity of their sets of shingles is at least ``similarity``, which is always checked on
    the sets.  Candidates are what the trie join of SimHash fingerprints connects within ``budget`` bits, and, as two texts
    of similarity 0.8 differ in about 10 of 64 bits, beyond any budget that a join can bear, texts that share a band of minimum hashes:
    at similarity s with probability 1 - (1 - s ** ROWS) ** BANDS, 0.9996 at 0.8 and more above, whatever the number of documents.
    All texts that candidates connect are compared.

    A null text is an empty one, and texts without words are copies of each other; a null id is larger than any other and is
    kept as null.  Of rows equal in id and text one stays.  An empty table gives an empty result; further columns are kept.
    """
    prints = banded(documents, shingle)
    texts = checkpoint(prints.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bands").alias("bands")))
    near = connected_components(trie_links(texts, budget).unionByName(band_links(texts)))
    candidates = checkpoint(texts.join(near, texts["print"] == near.node, "left").select("print", F.coalesce("root", "print").alias("root"), "n"))
    roots = connected_components(jaccard_links(documents, candidates, shingle, similarity))
    own_id, own_print, place = spare_names(documents, "__id", "__print", "__place")
    kept = texts.join(roots, texts["print"] == roots.node, "left").groupBy(F.coalesce("root", "print").alias("root")).agg(F.min(F.struct("doc_id", "print")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias(own_id), F.col("k.print").alias(own_print))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.withColumns({own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), own_print: F.xxhash64(text)}).join(kept, [own_id, own_print])
    first = F.row_number().over(Window.partitionBy(own_id, own_print).orderBy(own_id))
    return rows.withColumn(place, first).where(F.col(place) == 1).select(*documents.columns)
