"""Substring deduplication: word spans that already occur in an earlier document are removed.

A window of ``window`` words is removed if its words also start a window in a document with a smaller
id.  Windows are dealt to reference shards by content: the n-gram of ``gram`` words with the smallest
hash inside a window is its anchor, which every copy of the window shares wherever it stands.  The
windows of one anchor occurrence are consecutive and form a segment.  Segments with one content are
collapsed by hash first.  In a shard, documents then stream in order of their ids through a suffix
automaton of the segments seen before; matching statistics give the maximal spans of ``window`` words or
more that an earlier document holds.

Each shard's automaton is built where the shard's segments meet rather than broadcast to all tasks: with
every document being reference to every later one, broadcasting all shards would be quadratic.  A shard
whose anchor has more than ``shard_segments`` contents is cut in parts, and its segments stream
through each part, so that an automaton is bounded whatever the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Vocabulary, checkpoint, drop_stored, id_or_null, keyed, mix64, slices, small, stored
from .grams import flat_words

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 5) for w in words), np.uint64, len(words))


def _gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by Horner's rule."""
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_ODD) + h[k : k + n]
    return mix64(out)


def _anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` consecutive hashes, the first of equals."""
    place = np.arange(len(grams), dtype=np.uint64)
    value = (grams & ~np.uint64((1 << 28) - 1)) | place  # ties and near ties go to the earlier place
    have = 1
    while have < width:
        step = min(have, width - have)
        value = np.minimum(value[:-step], value[step:])
        have += step
    return (value & np.uint64((1 << 28) - 1)).astype(np.int64)


def segments(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, text, print) -> a row per document (kind 0) and per segment (kind 1).

    kind 0: size = number of words, digest = sha256 of the words joined by blanks.
    kind 1: anchor, start word and size of a segment, content = a hash of its words.
    print, a hash of the text, tells rows with one doc_id apart.
    """

    def document(doc: int, words: list[bytes], h: np.ndarray):
        n = len(h)
        if n < window:
            return None
        grams = _gram_hashes(h, gram)
        owner = _anchors(grams, window - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        count = np.diff(np.append(first, len(owner)))
        size = count + window - 1
        # Sums of scrambled words times powers; dividing by the power at the start makes equal runs equal wherever they stand.
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h + np.uint64(1)) * powers[0][:n])])
        content = (total[first + size] - total[first]) * powers[1][first]
        return grams[owner[first]], first, size, content

    powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def run(batches):
        vocabulary = Vocabulary(lambda words: _word_hashes(words)[:, None])
        for batch in batches:
            whole = batch.column(1).cast(pa.binary()).to_pylist()
            ids, prints = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for i, j in slices(np.fromiter(map(len, whole), np.int64, len(whole)), 1_500_000):
                words, counts = flat_words(whole[i:j])
                at = vocabulary.ids(words)
                h = vocabulary.table[at][:, 0] if words else np.zeros(0, np.uint64)
                if len(powers[0]) <= counts.max():
                    n = int(counts.max()) * 2 + 1
                    for k, base in enumerate((_ODD, _INVERSE)):
                        powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
                begin = np.cumsum(counts) - counts
                rows: list[list] = [[], [], [], [], [], []]  # doc_id, print, anchor, start, size, content
                digests = []
                for k in range(j - i):
                    own = words[begin[k] : begin[k] + counts[k]]
                    digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
                    found = document(ids[i + k], own, h[begin[k] : begin[k] + counts[k]])
                    if found is not None:
                        anchor, first, size, content = found
                        for held, new in zip(rows, (np.full(len(first), ids[i + k]), np.full(len(first), prints[i + k]), anchor.view(np.int64), first, size, content.view(np.int64))):
                            held.append(new)
                m = j - i
                zero = np.zeros(m, np.int64)
                yield batch_of(0, [ids[i:j], prints[i:j], zero, zero, counts, zero], digests)
                if rows[0]:
                    found = [np.concatenate(x) for x in rows]
                    yield batch_of(1, found, [None] * len(found[0]))

    def batch_of(kind, columns, digests):
        doc, text_print, anchor, start, size, content = columns
        names = ["kind", "doc_id", "print", "anchor", "start", "size", "content", "digest"]
        columns = [np.full(len(doc), kind, np.int8), doc, text_print, anchor, start.astype(np.int32), size.astype(np.int32), content]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(digests, pa.string())], names=names)

    return texts.mapInArrow(run, "kind byte, doc_id long, print long, anchor long, start int, size int, content long, digest string")


class SuffixAutomaton:
    """Online suffix automaton of word sequences, for matching statistics of further sequences."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, words: list) -> None:
        """Extend by one more sequence; the automaton then holds the substrings of all sequences added."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def spans(self, words: list, least: int) -> tuple[list[tuple[int, int]], bool]:
        """Union of all matches of ``least`` words or more, as ranges of words; whether the whole sequence is one match."""
        nxt, link, length = self.next, self.link, self.length
        state = have = 0
        out: list[tuple[int, int]] = []
        for i, w in enumerate(words):
            while w not in nxt[state] and state:
                state = link[state]
                have = length[state]
            to = nxt[state].get(w)
            if to is None:
                have = 0
            else:
                state, have = to, have + 1
            if have >= least:
                a = i + 1 - have
                if out and a <= out[-1][1]:
                    out[-1] = (min(out[-1][0], a), i + 1)
                else:
                    out.append((a, i + 1))
        return out, have == len(words)


def _judge_shards(rows: DataFrame, window: int) -> DataFrame:
    """rows(anchor, part, own, doc_id, print, start, words) -> (doc_id, print, start, size) of spans that an earlier document holds.

    Rows of one (anchor, part) come together in order of doc_id; only rows with ``own`` extend its automaton.
    """

    def run(batches):
        key, automaton, waiting, waiting_doc = None, None, [], None
        for batch in batches:
            docs, prints, starts, sizes = [], [], [], []
            for anchor, part, own, doc, text_print, start, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (anchor, part) != key:
                    key, automaton, waiting, waiting_doc = (anchor, part), SuffixAutomaton(), [], doc
                if doc != waiting_doc:
                    # A document is no reference to itself, so its segments wait until the next one.
                    for words in waiting:
                        automaton.add(words)
                    waiting, waiting_doc = [], doc
                words = text.split(b" ")
                spans, known = automaton.spans(words, window)
                for a, b in spans:
                    docs.append(doc)
                    prints.append(text_print)
                    starts.append(start + a)
                    sizes.append(b - a)
                if own and not known:
                    waiting.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(prints, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], names=["doc_id", "print", "start", "size"])

    keys = ["anchor", "part"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "doc_id", "start")
    return rows.select(*keys, "own", "doc_id", "print", "start", "words").mapInArrow(run, "doc_id long, print long, start int, size int")


def _cut_words(texts: DataFrame, wanted: DataFrame, schema: str, use) -> DataFrame:
    """Join each text with a list of its word ranges and apply ``use(doc_id, print, words, ranges)``, which yields output rows."""
    key = ["doc_id", "print"]
    ranges = wanted.groupBy(*key).agg(F.collect_list(F.struct(*[c for c in wanted.columns if c not in key])).alias("ranges"))
    joined = texts.join(ranges, key).select(*key, "text", "ranges")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            doc, text_print, text, held = batch.columns
            text = text.cast(pa.binary())
            for i, j in slices(pc.binary_length(text).to_numpy(zero_copy_only=False), 4_000_000):
                rows = [row for k in range(i, j) for row in use(doc[k].as_py(), text_print[k].as_py(), text[k].as_py().split(), held[k].as_py())]
                columns = zip(*rows) if rows else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return joined.mapInArrow(run, schema)


def deduplicate(documents: DataFrame, window: int = 50, gram: int = 16, shard_segments: int = 4000, collapse: bool = True) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256, spans array<struct<start, end>>), a row per input row.

    spans are the removed word ranges.  Null and empty texts have no words.  Rows of one doc_id are no reference to each
    other, and each keeps a row of its own; rows equal in id and text are judged once.  Rows without an id count as later than all others and are no reference to each
    other.  An empty table gives an empty result; further columns are ignored.

    Without ``collapse`` every occurrence goes through the automata; the result is the same.  With it, occurrences of one content are told
    by a 64-bit hash among those that share their anchor, so a false match takes a collision within one anchor's contents, not in the corpus.
    """
    rows = texts = keyed(documents).withColumn("print", F.xxhash64("text"))
    repeated = checkpoint(rows.groupBy("doc_id", "print").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "print"))
    repeats = repeated.limit(1).count() > 0
    if repeats:
        repeated = small(repeated)
        one = rows.join(repeated, ["doc_id", "print"], "left_semi").groupBy("doc_id", "print").agg(F.first("text").alias("text"))
        texts = rows.join(repeated, ["doc_id", "print"], "left_anti").unionByName(one).select(*rows.columns)
    found = stored(segments(texts, window, gram))
    parts = found.where("kind = 1")
    # Tables of their own: a join straight above an aggregate keeps its partitions, and Spark could not split a frequent anchor's rows.
    shared = stored(parts.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("anchor"))
    parts = stored(parts.join(shared, "anchor", "left_semi").select("doc_id", "print", "anchor", "start", "size", "content"))
    drop_stored(shared)
    content = ["anchor", "size", "content"] if collapse else ["anchor", "size", "content", "doc_id", "print", "start"]
    first = stored(parts.groupBy(*content).agg(F.min("doc_id").alias("first_doc")))
    # Copies of a content whose first document is smaller go whole; of each content the first document's occurrences are judged.
    copies = parts.join(first.select(*content, "first_doc"), content)
    several = first.groupBy("anchor").agg(F.count("*").alias("n"), F.min("first_doc").alias("a"), F.max("first_doc").alias("b")).where("a <> b")
    cuts = F.ceil(F.col("n") / shard_segments).cast("int").alias("cuts")
    several = stored(several.select("anchor", cuts))
    judged = copies.where("doc_id = first_doc").join(several, "anchor").select("doc_id", "print", "anchor", "start", "size", "cuts")
    copies = copies.where("doc_id > first_doc").select("doc_id", "print", "start", "size")

    def take_segments(doc, text_print, words, ranges):
        for r in ranges:
            yield r["anchor"], r["cuts"], doc, text_print, r["start"], b" ".join(words[r["start"] : r["start"] + r["size"]])

    cut = _cut_words(texts, judged, "anchor long, cuts int, doc_id long, print long, start int, words binary", take_segments)
    home = F.pmod(F.xxhash64("doc_id", "start"), F.col("cuts")).cast("int")
    cut = cut.withColumn("home", home).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("own", F.col("home") == F.col("part"))
    removed = stored(copies.unionByName(_judge_shards(cut, window)).distinct())
    drop_stored(parts, first, several)

    def drop_spans(doc, text_print, words, ranges):
        merged: list[list[int]] = []
        for a, n in sorted((r["start"], r["size"]) for r in ranges):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], a + n)
            else:
                merged.append([a, a + n])
        kept, at = [], 0
        for a, b in merged:
            kept += words[at:a]
            at = b
        kept += words[at:]
        yield doc, text_print, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in merged]

    schema = "doc_id long, print long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"
    changed = _cut_words(texts, removed, schema, drop_spans)
    intact = found.where("kind = 0").join(removed.select("doc_id", "print").distinct(), ["doc_id", "print"], "left_anti")
    nothing = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    intact = intact.select("doc_id", "print", F.col("size").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), nothing.alias("spans"))
    out = changed.unionByName(intact)
    if repeats:
        copies = rows.select("doc_id", "print").join(repeated, ["doc_id", "print"], "left_semi")
        out = out.join(repeated, ["doc_id", "print"], "left_anti").unionByName(copies.join(out, ["doc_id", "print"]).select(*out.columns))
    return out.drop("print").withColumn("doc_id", id_or_null("doc_id"))
