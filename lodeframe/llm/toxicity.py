"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's logit is the sum of its words' weights, a word's weight the sum over hashed features
(the word and its n-grams).  Sentence probabilities are combined by noisy-or, and the weights are
learned from document labels alone; the sentences that carry the score are then located.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Vocabulary
from .grams import Adam, flat_words, gram_hashes, labelled_sample, score_texts

GRAMS = (5, 6, 7)
#: Words in a sentence at most, where no mark ends it before.
LONGEST = 48
#: Least ratio of document shares at which a feature may carry weight.
LEAST_LIFT = 3.0
_EDGE = b"\"'()[]{}<>,;:*_~|#$%&!?.-"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float


def _sentence_starts(ends_here: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes of the first words of all sentences; texts without words have none."""
    n = len(ends_here)
    first = np.zeros(n + 1, bool)
    begin = np.cumsum(counts) - counts
    first[begin[counts > 0]] = True
    first[1:] |= ends_here
    starts = np.flatnonzero(first[:n])
    lens = np.diff(np.append(starts, n))
    pieces = -(-lens // LONGEST)
    return np.repeat(starts - LONGEST * (np.cumsum(pieces) - pieces), pieces) + LONGEST * np.arange(pieces.sum())


def _bare(words: list[bytes]) -> list[bytes]:
    return [w.strip(_EDGE) or w for w in words]


def _ends(words: list[bytes]) -> np.ndarray:
    return np.fromiter((w[-1] in b".!?" for w in words), bool, len(words))


def _lift(features: np.ndarray, owners: np.ndarray, bag: np.ndarray, y: np.ndarray, dims: int) -> np.ndarray:
    """Cautious ratio of the shares of toxic and of other documents that hold each feature.

    bag: document * words + word for every distinct pair.
    """
    n_words = int(owners.max()) + 1
    order = np.argsort(owners, kind="stable")
    per_word = np.bincount(owners, minlength=n_words)
    begin = np.cumsum(per_word) - per_word
    holders = np.zeros((2, dims))
    for document in range(len(y)):
        lo, hi = np.searchsorted(bag, [document * n_words, (document + 1) * n_words])
        word = bag[lo:hi] - document * n_words
        at = np.repeat(begin[word] - (np.cumsum(per_word[word]) - per_word[word]), per_word[word]) + np.arange(per_word[word].sum())
        holders[int(y[document]), np.unique(features[order[at]])] += 1
    toxic, other = np.maximum(holders[1] - 1, 0) / max(1, y.sum()), (holders[0] + 1) / (len(y) - y.sum() + 1)
    return toxic / other


def sentence_words(texts: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, words binary, sentence binary, word binary): what learning needs of a lower-cased text.

    words: its different words, joined by blanks; sentence and word: as 32-bit numbers, every pair of a sentence and one of those words in it.
    """

    def task():
        def apply(found):
            names, sentences, ids = [], [], []
            for text in found:
                words = text.split()
                index: dict[bytes, int] = {}
                at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
                starts = _sentence_starts(_ends(words), np.array([len(words)]))
                lengths = np.diff(np.append(starts, len(words)))
                once = np.unique(np.repeat(np.arange(len(starts)), lengths) * np.int64(max(1, len(index))) + at)
                names.append(b" ".join(index))
                sentences.append((once // max(1, len(index))).astype("<u4").tobytes())
                ids.append((once % max(1, len(index))).astype("<u4").tobytes())
            return [pa.array(x, pa.binary()) for x in (names, sentences, ids)]

        return apply

    return score_texts(texts, task, "words binary, sentence binary, word binary", lower=True)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 2400, dims: int = 1 << 17, rounds: int = 400) -> ToxicityModel:
    """labels(doc_id, toxic) -> a model learned from at most ``per_class`` labelled documents of either class.

    The words of the sample's sentences reach the driver, within the bound of bytes of ``labelled_sample``; texts do not.
    """
    sample = labelled_sample(documents, labels, "toxic", per_class)
    # The label rides along as the id of the rows.
    rows = sentence_words(sample.select(F.col("label").cast("long").alias("doc_id"), "text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["words"], r["word"]))
    index: dict[bytes, int] = {}
    sentence_of, document, ids, n_sentences = [], [], [], 0
    for k, r in enumerate(rows):
        own = np.fromiter((index.setdefault(w, len(index)) for w in r["words"].split()), np.int64)
        ids.append(own[np.frombuffer(r["word"], "<u4")] if len(own) else own)
        sentence = np.frombuffer(r["sentence"], "<u4").astype(np.int64)
        sentence_of.append(sentence + n_sentences)
        document.append(np.full(int(sentence.max(initial=-1)) + 1, k))
        n_sentences += len(document[-1])
    y = np.array([r["doc_id"] for r in rows], float)
    return learn(list(index), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, sentence_of, document)), y, dims, rounds)


def learn(known: list[bytes], ids: np.ndarray, sentence_of: np.ndarray, document: np.ndarray, y: np.ndarray, dims: int, rounds: int) -> ToxicityModel:
    """known words, pairs of words and sentences (ids, sentence_of), each sentence's document, each document's label -> a model."""
    if not known or len(set(y)) < 2:
        share = y.mean() if len(y) else 0.0
        return ToxicityModel(np.zeros(dims, np.float32), float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))))
    features, owners = gram_hashes(_bare(known), GRAMS, dims, whole=True)
    n_features = np.maximum(np.bincount(owners, minlength=len(known)), 1)
    # Only features that toxic documents hold more often than chance may carry weight, and none may excuse a sentence.
    bag = np.unique(document[sentence_of] * np.int64(len(known)) + ids)
    lift = _lift(features, owners, bag, y, dims)
    able = lift >= LEAST_LIFT
    # Words without such a feature weigh nothing; their sentences stay, at the bias.
    bears = able[features]
    features, owners = features[bears], owners[bears]
    heavy = np.isin(ids, owners)
    ids, sentence_of = ids[heavy], sentence_of[heavy]
    w, adam = {"w": np.where(able, np.log(np.maximum(lift, 1)), 0.0), "b": np.array(-4.0)}, Adam(0.05)
    class_weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum()))
    for _ in range(rounds):
        word = np.bincount(owners, w["w"][features], minlength=len(known)) / np.sqrt(n_features)
        z = np.clip(np.bincount(sentence_of, word[ids], minlength=len(document)) + w["b"], -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_none = np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        none = np.exp(log_none)
        pull = np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0) * class_weight
        dz = -p * pull[document] / len(y)
        dword = np.bincount(ids, dz[sentence_of], minlength=len(known)) / np.sqrt(n_features)
        grad = np.where(able, np.bincount(features, dword[owners], minlength=dims) + 1e-5 * w["w"], 0.0)
        adam.step(w, {"w": grad, "b": dz.sum()})
        w["w"] = np.maximum(w["w"], 0.0)
    return ToxicityModel(w["w"].astype(np.float32), float(w["b"]))


def score(documents: DataFrame, model: ToxicityModel, offending: float = 0.5) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, score, sentences array<struct<start, end, score>>), a row per input row.

    score is the noisy-or over all sentences of the whole text; sentences lists those of probability ``offending`` or
    more by their byte range in the lower-cased text.  A null or empty text, or one of blanks only, scores 0.
    Repeated rows score alike; an empty table gives an empty result; further columns are ignored.
    """
    dims = len(model.weights)

    def rows(words):
        features, owners = gram_hashes(_bare(words), GRAMS, dims, whole=True)
        n = np.maximum(np.bincount(owners, minlength=len(words)), 1)
        return np.stack([np.bincount(owners, model.weights[features], minlength=len(words)) / np.sqrt(n), _ends(words)], axis=1)

    def task():
        vocabulary = Vocabulary(rows)

        def apply(texts):
            words, counts = flat_words(texts)
            ids = vocabulary.ids(words)
            out, found = np.zeros(len(texts)), [[] for _ in texts]
            if len(ids):
                weight, ends = vocabulary.table[ids].T
                starts = _sentence_starts(ends > 0, counts)
                heavy = np.flatnonzero(weight)
                once = np.unique((np.searchsorted(starts, heavy, "right") - 1) * np.int64(len(vocabulary)) + ids[heavy])
                z = np.bincount(once // len(vocabulary), vocabulary.table[once % len(vocabulary), 0], minlength=len(starts))
                p = 1 / (1 + np.exp(-np.clip(z + model.bias, -30, 30)))
                document = np.repeat(np.arange(len(texts)), counts)[starts]
                out = -np.expm1(np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts)))
                stop = np.append(starts[1:], len(ids))
                begin = np.cumsum(counts) - counts
                spans: dict[int, list] = {}
                for s in np.flatnonzero(p >= offending):
                    d = int(document[s])
                    if d not in spans:
                        spans[d] = [m.span() for m in _WORD.finditer(texts[d])]
                    a, b = spans[d][starts[s] - begin[d]], spans[d][stop[s] - begin[d] - 1]
                    found[d].append({"start": a[0], "end": b[1], "score": float(p[s])})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            return [pa.array(np.clip(out, 0.0, 1.0)), pa.array(found, kind)]

        return apply

    return score_texts(documents, task, "score double, sentences array<struct<start:int,end:int,score:double>>", lower=True)
