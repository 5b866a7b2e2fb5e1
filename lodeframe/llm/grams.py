"""Hashed character n-grams of words, and the flat word form in which texts are scored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mix64, slices, small


def flat_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of all texts in one list, and how many each text has."""
    split = [t.split() for t in texts]
    return [w for words in split for w in words], np.fromiter(map(len, split), np.int64, len(split))


def gram_hashes(words: list[bytes], sizes: tuple[int, ...], dims: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers below ``dims`` of every word's n-grams of bytes, blanks at its ends included, and the words they belong to.

    ``whole`` adds one feature for the whole word.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blob = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, n)
    starts = 1 + np.cumsum(lens + 1) - (lens + 1)
    features, owners = [], []
    for size in sizes:
        pad = size > 1
        counts = np.maximum(lens + 2 * pad - size + 1, 0)
        owner = np.repeat(np.arange(n), counts)
        at = np.repeat(starts - pad - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = h * np.uint64(1099511628211) + blob[at + k]
        features.append(h)
        owners.append(owner)
    if whole:
        h = np.zeros(len(blob) + 1, np.uint64)
        powers = np.cumprod(np.full(len(blob), 0x9E3779B97F4A7C15, np.uint64))
        h[1:] = np.cumsum(mix64(blob + np.uint64(977)) * powers)
        # Dividing by the power at the start makes equal words equal wherever they stand.
        inverse = np.cumprod(np.full(len(blob), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
        features.append((h[starts + lens] - h[starts]) * inverse[starts])
        owners.append(np.arange(n))
    features = (mix64(np.concatenate(features)) % np.uint64(dims)).astype(np.int64)
    return features, np.concatenate(owners)


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run sums to zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def score_texts(documents: DataFrame, score, schema: str, lower: bool = False, chunk: int = 1_500_000) -> DataFrame:
    """Run ``score(texts: list[bytes]) -> list of columns`` over chunks of whole texts; doc_id is passed through, a null text is empty.

    ``score`` is a factory: it is called once per task, so that its vocabulary lives as long as the task.
    """

    def run(batches):
        apply = score()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for i, j in slices(np.fromiter(map(len, texts), np.int64, len(texts)), chunk):
                columns = apply(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=names)
        # Workers outlive their task; what its vocabulary and batches held should not.
        del apply
        pa.default_memory_pool().release_unused()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lower(text) if lower else text).alias("text"))
    names = ["doc_id", *(c.strip().split()[0] for c in schema.split(", "))]
    return rows.mapInArrow(run, f"doc_id long, {schema}")


def keep_texts(documents: DataFrame, judge, chunk: int = 1_500_000) -> DataFrame:
    """The rows whose whole text ``judge(texts: list[bytes]) -> list of booleans`` accepts, with all columns; nothing is shuffled.

    ``judge`` is a factory, as in ``score_texts``; a null text is judged as an empty one.
    """
    at = documents.columns.index("text")

    def run(batches):
        apply = judge()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).fill_null(b"").to_pylist()
            for i, j in slices(np.fromiter(map(len, texts), np.int64, len(texts)), chunk):
                yield batch.slice(i, j - i).filter(pa.array(apply(texts[i:j]), pa.bool_()))
        del apply
        pa.default_memory_pool().release_unused()

    return documents.mapInArrow(run, documents.schema)


def held_out(modulus: int, remainder: int):
    """Whether a row's crc32(doc_id as text) leaves ``remainder``; a row without an id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, most: int = 20_000, most_bytes: int = 16_000_000, most_classes: int = 1000) -> DataFrame:
    """(doc_id, text, label) of about ``per_class`` labelled rows of every class, ``most`` in all and at most ``most_bytes`` of text, chosen by a hash of the id.

    labels(doc_id, label); rows without an id or a label are left out.  A class of up to ``per_class`` ids is taken whole; of a larger one
    an id is taken if its hash lies in the share that gives ``per_class``, so nothing is ranked.  An id counts once in a class however often
    it is repeated in either table; of its texts the smallest is taken.  Where the texts are more than ``most_bytes``, the longest are
    left out.  Of more than ``most_classes`` classes the most frequent are learned.  These bounds, which hold for the learning of models only, make the sample small enough to be broadcast and collected.
    """
    known = labels.select("doc_id", F.col(label).alias("label")).where("doc_id is not null and label is not null").distinct()
    classes = small(known.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most_classes))
    per_class = max(1, min(per_class, most // max(1, classes.count())))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    chosen = known.join(classes, "label").where(place * F.col("n") < per_class).select("doc_id", "label")
    texts = documents.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = texts.join(small(chosen, 2 * most), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    one = checkpoint(one.select("doc_id", "text", "label", F.octet_length("text").cast("long").alias("bytes"), F.xxhash64("doc_id", "label").alias("hash")))
    sizes = sorted((r["bytes"], r["hash"]) for r in one.select("bytes", "hash").collect())  # two numbers a row of the sample
    fit = int(np.searchsorted(np.cumsum([n for n, _ in sizes]), most_bytes, "right"))
    if fit < len(sizes):
        one = one.where(F.struct("bytes", "hash") < F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(sizes[fit], ("bytes", "hash"))]))
    return one.select("doc_id", "text", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "label")


class Adam:
    """The usual first-order optimiser over a dict of arrays."""

    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g * g
            weights[k] = weights[k] - self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
