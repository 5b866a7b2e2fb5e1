"""Language identification with error-correcting output codes.

Every language gets a codeword.  One logistic classifier over hashed character n-grams predicts each
bit; decoding weighs every bit's logistic loss by how well that bit did in training and picks the
nearest codeword.  The gap to the second nearest flags ambiguous texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Vocabulary
from .grams import Adam, flat_words, gram_hashes, labelled_sample, score_texts, segment_sums

GRAMS = (1, 2, 3)
LETTER = regex.compile(r"\p{L}")


def codewords(classes: int, seed: int = 11) -> np.ndarray:
    """Codewords of -1 and 1, a row per class: every split of up to 6 classes, else seeded random splits."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        # Each column is one way to split the classes in two; the first class is always on the side of 1.
        return np.array([(1, *c) for c in product((1, -1), repeat=classes - 1) if -1 in c]).T.astype(float)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    while True:
        code = np.where(rng.random((classes, length)) < 0.5, 1.0, -1.0)
        apart = min(np.sum(code[i] != code[j]) for i in range(classes) for j in range(i))
        if apart >= length // 4 and (np.abs(code.sum(0)) < classes).all():
            return code


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # classes x bits
    weights: np.ndarray  # dims x bits
    bias: np.ndarray
    bit_weight: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, its probability, and whether the two nearest codewords are about as near."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.bit_weight
        order = np.argsort(loss, axis=1, kind="stable")
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = order[:, 0]
        rows = np.arange(len(loss))
        unsure = (loss[rows, order[:, 1]] - loss[rows, best] < 0.5) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, p[rows, best], unsure


def gram_counts(texts: DataFrame, dims: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, at binary, n binary): numbers of the n-gram features of a lower-cased text and how often each occurs, as 32-bit numbers."""

    def task():
        def apply(found):
            at, n = [], []
            for text in found:
                features, counts = np.unique(gram_hashes(text.split(), GRAMS, dims)[0], return_counts=True)
                at.append(features.astype("<u4").tobytes())
                n.append(counts.astype("<u4").tobytes())
            return [pa.array(at, pa.binary()), pa.array(n, pa.binary())]

        return apply

    return score_texts(texts, task, "at binary, n binary", lower=True)


def fit(documents: DataFrame, per_language: int = 400, dims: int = 8192, epochs: int = 80, batch: int = 256, seed: int = 13) -> LanguageModel:
    """documents(doc_id, text, lang) -> a model learned from at most ``per_language`` documents of each non-null language.

    Counts of the sample's n-grams reach the driver, not texts.  They are kept as they are, few per text, and spread out to all
    features for one batch of texts at a time.
    """
    sample = labelled_sample(documents, documents.select("doc_id", "lang"), "lang", per_language).where("text <> ''")
    languages = sorted(r["label"] for r in sample.select("label").distinct().collect())
    number = F.array_position(F.array(*[F.lit(v) for v in languages]), F.col("label")) - 1 if languages else F.lit(0)
    # The language's number rides along as the id of the rows.
    rows = sorted(gram_counts(sample.select(number.alias("doc_id"), "text"), dims).collect(), key=lambda r: (r["doc_id"], r["at"], r["n"]))
    code = codewords(len(languages))
    y = code[[r["doc_id"] for r in rows]] if rows else np.zeros((0, code.shape[1]))
    at = [np.frombuffer(r["at"], "<u4").astype(np.int64) for r in rows]
    share = [(n := np.frombuffer(r["n"], "<u4").astype(float)) / max(1.0, n.sum()) for r in rows]
    squares = np.bincount(np.concatenate(at), np.concatenate(share) ** 2, minlength=dims) / len(rows) if rows else np.ones(dims)
    scale = 1 / np.maximum(np.sqrt(squares), 1e-4)

    def spread(chosen: np.ndarray) -> np.ndarray:
        x = np.zeros((len(chosen), dims), np.float32)
        for k, row in enumerate(chosen):
            x[k, at[row]] = share[row] * scale[at[row]]
        return x

    def batches(order: np.ndarray):
        return (order[k : k + batch] for k in range(0, len(order), batch))

    w = {"w": np.zeros((dims, code.shape[1]), np.float32), "b": np.zeros(code.shape[1], np.float32)}
    rng, adam = np.random.default_rng(seed), Adam(0.01)
    for _ in range(epochs if len(languages) > 1 else 0):
        for chosen in batches(rng.permutation(len(rows))):
            x, own = spread(chosen), y[chosen]
            pull = -own / (1 + np.exp(np.clip(own * (x @ w["w"] + w["b"]), -30, 30)))
            adam.step(w, {"w": (x.T @ pull.astype(np.float32)) / len(own) + 1e-4 * w["w"], "b": pull.mean(0).astype(np.float32)})
    right = sum(((spread(c) @ w["w"] + w["b"]) * y[c] > 0).sum(0) for c in batches(np.arange(len(rows)))) / len(rows) if rows else np.ones(code.shape[1])
    weight = np.maximum(2 * right - 1, 0.05)
    return LanguageModel(languages, code, (w["w"] * scale[:, None]).astype(np.float32), w["b"], weight)


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, lang_pred, score, ambiguous), a row per input row.

    Whole texts are scored: a text's margin for a bit is the mean over all its n-grams.  A null, empty or letterless
    text, or a model without languages, gives ``und`` with score 0.  Of codewords that are equally near, the first language by
    code point is taken and the row is ambiguous.  Repeated rows score alike; an empty table gives an empty result; further columns
    are ignored.
    """
    dims, bits = model.weights.shape

    def rows(words):
        features, owners = gram_hashes(words, GRAMS, dims)
        out = np.zeros((len(words), bits + 1))
        for b in range(bits):
            out[:, b] = np.bincount(owners, model.weights[features, b], minlength=len(words))
        out[:, bits] = np.bincount(owners, minlength=len(words))
        return out

    def task():
        vocabulary = Vocabulary(rows)

        def score(texts):
            words, counts = flat_words(texts)
            ids = vocabulary.ids(words)
            sums = segment_sums(vocabulary.table[ids], counts) if len(ids) else np.zeros((len(texts), bits + 1))
            lettered = np.fromiter((LETTER.search(t.decode()) is not None for t in texts), bool, len(texts)) & (len(model.languages) > 0)
            if not len(model.languages):
                return [pa.array(["und"] * len(texts)), pa.array(np.zeros(len(texts))), pa.array(np.zeros(len(texts), bool))]
            best, p, unsure = model.decode(sums[:, :bits] / np.maximum(sums[:, bits:], 1) + model.bias)
            found = [model.languages[k] if ok else "und" for k, ok in zip(best, lettered)]
            return [pa.array(found), pa.array(np.where(lettered, p, 0.0)), pa.array(unsure & lettered)]

        return score

    return score_texts(documents, task, "lang_pred string, score double, ambiguous boolean", lower=True)
