"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded by how its words look and repeat; a gated
attention unit, learned together with the encoder and the output from document labels, says how much
each passage counts, and the weighted passage representation is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Vocabulary
from .grams import Adam, flat_words, keep_texts, labelled_sample, score_texts

PASSAGE_WORDS = 64
WORD_FEATURES = 16
PASSAGE_FEATURES = WORD_FEATURES + 8


def _word_rows(words: list[bytes]) -> np.ndarray:
    """How each word looks: length, shares of kinds of characters, and some flags.  The last column is the word's own number."""
    n = len(words)
    blob = np.frombuffer(b"".join(words), np.uint8)
    lens = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(lens) - lens
    kinds = [
        (blob >= 65) & (blob <= 90),
        (blob >= 97) & (blob <= 122) | (blob >= 128),
        (blob >= 48) & (blob <= 57),
        np.isin(blob, np.frombuffer(b"#$%&*@^~+=_\\", np.uint8)),
        np.isin(blob, np.frombuffer(b"|<>{}[]/", np.uint8)),
        blob == 33,
        np.isin(blob, np.frombuffer(b",;:", np.uint8)),
        np.isin(blob, np.frombuffer(b".?", np.uint8)),
    ]
    shares = [np.add.reduceat(k.astype(np.int64), starts) / lens for k in kinds]
    upper, lower, digit = shares[:3]
    last = blob[starts + lens - 1]
    out = np.zeros((n, WORD_FEATURES), np.float32)
    out[:, :8] = np.stack(shares, 1)
    out[:, 8] = np.log1p(lens)
    out[:, 9] = lens > 20
    out[:, 10] = (upper > 0) & (lower == 0)
    out[:, 11] = np.isin(last, np.frombuffer(b".!?", np.uint8))
    out[:, 12] = (upper + lower + digit) == 0
    out[:, 13] = digit > 0
    out[:, 14] = np.isin(last, np.frombuffer(b"#$%&*@", np.uint8))
    out[:, 15] = lens == 1
    return out


def _passages(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of passages of about equal length, at most PASSAGE_WORDS words, and how many each text has."""
    pieces = -(-counts // PASSAGE_WORDS)
    document = np.repeat(np.arange(len(counts)), pieces)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.cumsum(counts) - counts
    return begin[document] + k * counts[document] // np.maximum(pieces[document], 1), pieces


def encode_passages(ids: np.ndarray, table: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of whole texts, and how many passages each text has."""
    starts, pieces = _passages(counts)
    if not len(starts):
        return np.zeros((0, PASSAGE_FEATURES), np.float32), pieces
    stop = np.append(starts[1:], len(ids))
    size = (stop - starts).astype(np.float32)
    means = np.add.reduceat(table[ids], starts, axis=0) / size[:, None]
    passage = np.repeat(np.arange(len(starts)), stop - starts)
    document = np.repeat(np.arange(len(counts)), pieces)

    def distinct(group: np.ndarray, groups: int) -> np.ndarray:
        """Number of distinct words in every group."""
        key = np.unique(group * np.int64(len(table) + 1) + ids)
        return np.bincount(key // np.int64(len(table) + 1), minlength=groups)

    own = distinct(passage, len(starts)) / size
    whole = distinct(np.repeat(np.arange(len(counts)), counts), len(counts)) / np.maximum(counts, 1)
    again = np.zeros(len(ids), np.float32)
    again[1:] = (ids[1:] == ids[:-1]) & (passage[1:] == passage[:-1])
    twice = np.zeros(len(ids), np.float32)
    twice[2:] = (ids[2:] == ids[:-2]) & (passage[2:] == passage[:-2])
    spread = np.add.reduceat((table[ids, 8] ** 2), starts) / size - means[:, 8] ** 2
    extra = [own, np.add.reduceat(again, starts) / size, np.add.reduceat(twice, starts) / size, whole[document], np.log1p(counts[document]) / 10, np.log1p(size) / 5, spread, np.minimum(own, whole[document] * 2)]
    return np.concatenate([means, np.stack(extra, 1)], 1).astype(np.float32), pieces


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    threshold: float = 0.7

    def forward(self, x: np.ndarray, pieces: np.ndarray) -> dict[str, np.ndarray]:
        """Passage codes, attention and document scores; a text without passages gets the score of an all-zero representation."""
        w, bag = self.w, np.repeat(np.arange(len(pieces)), pieces)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["H"] + w["h"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        e = (t * s) @ w["a"]
        top = np.full(len(pieces), -np.inf)
        np.maximum.at(top, bag, e)
        e = np.exp(e - top[bag])
        attention = e / np.bincount(bag, e, minlength=len(pieces))[bag]
        z = np.zeros((len(pieces), h.shape[1]))
        np.add.at(z, bag, attention[:, None] * h)
        score = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        return {"x": x, "bag": bag, "h": h, "t": t, "s": s, "attention": attention, "z": z, "score": score}


def _gradients(model: QualityModel, f: dict, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    w, bag, h, t, s, a = model.w, f["bag"], f["h"], f["t"], f["s"], f["attention"]
    d = (f["score"] - y) * weight / len(y)
    dz = d[:, None] * w["c"]
    dh = a[:, None] * dz[bag]
    da = np.sum(dz[bag] * h, axis=1)
    de = a * (da - np.bincount(bag, a * da, minlength=len(y))[bag])
    dt, ds = de[:, None] * w["a"] * s * (1 - t * t), de[:, None] * w["a"] * t * s * (1 - s)
    dh = (dh + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    grads = {"c": f["z"].T @ d, "b": d.sum(), "a": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds, "H": f["x"].T @ dh, "h": dh.sum(0)}
    return {k: g + 1e-4 * w[k] for k, g in grads.items()}


def _features(documents: DataFrame) -> DataFrame:
    """(doc_id, label carried as text id) rows with each text's passage features in one binary column."""

    def task():
        vocabulary = Vocabulary(_word_rows)

        def apply(texts):
            words, counts = flat_words(texts)
            ids = vocabulary.ids(words)
            x, pieces = encode_passages(ids, vocabulary.table, counts) if len(ids) else (np.zeros((0, PASSAGE_FEATURES), np.float32), np.zeros(len(texts), np.int64))
            ends = np.cumsum(pieces)
            return [pa.array([x[e - n : e].tobytes() for e, n in zip(ends, pieces)], pa.binary())]

        return apply

    return score_texts(documents, task, "passages binary")


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 1500, width: int = 16, gate: int = 8, rounds: int = 400, seed: int = 3) -> QualityModel:
    """labels(doc_id, quality) -> a model learned from at most ``per_class`` labelled documents of either class."""
    sample = labelled_sample(documents, labels, "quality", per_class)
    # The label rides along as the id of the scored rows; only passage features reach the driver, not texts.
    rows = _features(sample.select(F.col("label").cast("long").alias("doc_id"), "text")).collect()
    bags = [np.frombuffer(r.passages, np.float32).reshape(-1, PASSAGE_FEATURES) for r in rows]
    order = sorted(range(len(bags)), key=lambda k: (rows[k].doc_id, rows[k].passages))
    y, bags = np.array([rows[k].doc_id for k in order], float), [bags[k] for k in order]
    x = np.concatenate(bags) if bags else np.zeros((0, PASSAGE_FEATURES), np.float32)
    pieces = np.fromiter(map(len, bags), np.int64, len(bags))
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(PASSAGE_FEATURES), np.ones(PASSAGE_FEATURES))
    w = {
        "H": rng.normal(0, 0.3, (PASSAGE_FEATURES, width)), "h": np.zeros(width),
        "V": rng.normal(0, 0.3, (width, gate)), "U": rng.normal(0, 0.3, (width, gate)), "a": rng.normal(0, 0.3, gate),
        "c": rng.normal(0, 0.3, width), "b": np.array(0.0),
    }
    model, adam = QualityModel(mean, scale, w), Adam(0.02)
    if len(set(y)) == 2:
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        for _ in range(rounds):
            adam.step(w, _gradients(model, model.forward(x, pieces), y, weight))
    return model


def score(documents: DataFrame, model: QualityModel) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, score, weakest int), a row per input row; higher: label 1 likelier.

    All passages of the whole text take part.  weakest is the number of the passage, from 0, with the most attention (null
    for a text without words).  A null, empty or blank text gets the score of an empty representation, the model's prior.
    Repeated rows score alike; an empty table gives an empty result; further columns are ignored.
    """

    def task():
        vocabulary = Vocabulary(_word_rows)

        def apply(texts):
            words, counts = flat_words(texts)
            ids = vocabulary.ids(words)
            x, pieces = encode_passages(ids, vocabulary.table, counts) if len(ids) else (np.zeros((0, PASSAGE_FEATURES), np.float32), np.zeros(len(texts), np.int64))
            f = model.forward(x, pieces)
            ends = np.cumsum(pieces)
            most = [int(np.argmax(f["attention"][e - n : e])) if n else None for e, n in zip(ends, pieces)]
            return [pa.array(f["score"]), pa.array(most, pa.int32())]

        return apply

    return score_texts(documents, task, "score double, weakest int")


def accepted(documents: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns.

    A null or empty text gets the model's prior; repeated rows score alike; an empty table gives an empty result.
    """

    def task():
        vocabulary = Vocabulary(_word_rows)

        def apply(texts):
            words, counts = flat_words(texts)
            ids = vocabulary.ids(words)
            x, pieces = encode_passages(ids, vocabulary.table, counts) if len(ids) else (np.zeros((0, PASSAGE_FEATURES), np.float32), np.zeros(len(texts), np.int64))
            return (model.forward(x, pieces)["score"] >= threshold).tolist()

        return apply

    return keep_texts(documents, task)
