"""Learned scores against plain Python that follows their definitions word by word, on a few texts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import grams, langid, quality, toxicity

MASK, ODD = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def gram_features(word, sizes, dims, whole=False):
    out = []
    for size in sizes:
        padded = b" " + word + b" " if size > 1 else word
        for k in range(len(padded) - size + 1):
            h = size
            for b in padded[k : k + size]:
                h = (h * 1099511628211 + b) & MASK
            out.append(mix(h) % dims)
    if whole:
        out.append(mix(sum(mix(b + 977) * pow(ODD, k, 1 << 64) for k, b in enumerate(word)) & MASK) % dims)
    return out


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


@pytest.fixture(scope="module")
def corpus(spark, docs):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice(["ka", "lo", "Mi", "ten", "é", "x7", "-", "ru"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for k in range(120):
        words = [word() + rng.choice(["", "", "", ".", "!", ","]) for _ in range(rng.choice([1, 5, 60, 130, 200]))]
        if k % 3 == 0:
            words.insert(rng.randrange(len(words) + 1), "vileword")
        rows.append((k, " ".join(words), "a", "xyz"[k % 3] if k % 7 else None))
        labels.append((k, k % 2, int(k % 3 == 0)))
    rows += [(k, t, "a", None) for k, t in ((500, None), (501, " "), (502, "..."))]
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: (r[1] or "").encode() for r in rows}


def test_toxicity_sentence_by_sentence(corpus):
    documents, labels, texts = corpus
    model = toxicity.fit(documents, labels, dims=1 << 12, rounds=40)
    assert model.weights.max() > 0
    edge = b"\"'()[]{}<>,;:*_~|#$%&!?.-"
    for r in toxicity.score(documents, model).collect():
        sentences, now = [], []
        for w in texts[r["doc_id"]].decode().lower().encode().split():
            now.append(w)
            if w[-1:] in (b".", b"!", b"?") or len(now) == toxicity.LONGEST:
                sentences.append(now)
                now = []
        none = 1.0
        for s in sentences + ([now] if now else []):
            z = model.bias
            for w in set(s):
                at = gram_features(w.strip(edge) or w, toxicity.GRAMS, 1 << 12, whole=True)
                z += sum(float(model.weights[f]) for f in at) / math.sqrt(len(at))
            none *= 1 - sigmoid(max(-30, min(30, z)))
        assert r["score"] == pytest.approx(1 - none, abs=1e-6)


def test_language_gram_by_gram(corpus):
    documents, _, texts = corpus
    model = langid.fit(documents, dims=512, epochs=5)
    assert model.languages == ["x", "y", "z"]
    for r in langid.identify(documents, model).collect():
        text = texts[r["doc_id"]].decode().lower()
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, False)
            continue
        at = [f for w in text.encode().split() for f in gram_features(w, langid.GRAMS, 512)]
        margin = np.mean([model.weights[f] for f in at], axis=0) + model.bias
        loss = [sum(math.log1p(math.exp(-m * c)) * b for m, c, b in zip(margin, code, model.bit_weight)) for code in model.code]
        best = min(range(3), key=lambda k: (loss[k], k))
        p = [math.exp(min(loss) - x) for x in loss]
        assert r["lang_pred"] == "xyz"[best] and r["score"] == pytest.approx(p[best] / sum(p), abs=1e-4)


def test_languages_of_equal_codewords_and_empty_tables(corpus):
    documents, _, _ = corpus
    model = langid.fit(documents, dims=64, epochs=1)
    tied = langid.LanguageModel(model.languages, np.ones_like(model.code), model.weights, model.bias, model.bit_weight)
    rows = langid.identify(documents.where("doc_id = 3"), tied).collect()
    assert [(r["lang_pred"], r["ambiguous"]) for r in rows] == [("x", True)] and rows[0]["score"] == pytest.approx(1 / 3)
    assert langid.identify(documents.limit(0), model).count() == 0 and toxicity.score(documents.limit(0), toxicity.ToxicityModel(np.zeros(8, np.float32), 0.0)).count() == 0


def passage_features(words, whole):
    def row(w):
        share = lambda ok: sum(map(ok, w)) / len(w)
        upper, lower, digit = share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122 or b >= 128), share(lambda b: 48 <= b <= 57)
        kinds = [upper, lower, digit, share(lambda b: b in b"#$%&*@^~+=_\\"), share(lambda b: b in b"|<>{}[]/"), share(lambda b: b == 33), share(lambda b: b in b",;:"), share(lambda b: b in b".?")]
        return kinds + [math.log1p(len(w)), len(w) > 20, upper > 0 and lower == 0, w[-1] in b".!?", upper + lower + digit == 0, digit > 0, w[-1] in b"#$%&*@", len(w) == 1]

    n, rows = len(words), np.array([row(w) for w in words], float)
    means = rows.mean(0)
    own, all_of = len(set(words)) / n, len(set(whole)) / len(whole)
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    twice = sum(a == b for a, b in zip(words, words[2:])) / n
    return [*means, own, again, twice, all_of, math.log1p(len(whole)) / 10, math.log1p(n) / 5, (rows[:, 8] ** 2).mean() - means[8] ** 2, min(own, 2 * all_of)]


def test_quality_passage_by_passage(corpus):
    documents, labels, texts = corpus
    m = quality.fit(documents, labels, rounds=10)
    for r in quality.score(documents, m).collect():
        words = texts[r["doc_id"]].split()
        pieces = -(-len(words) // quality.PASSAGE_WORDS)
        cuts = [k * len(words) // max(pieces, 1) for k in range(pieces)] + [len(words)]
        codes, pulls = [], []
        for a, b in zip(cuts, cuts[1:]):
            x = (np.array(passage_features(words[a:b], words)) - m.mean) / m.scale
            h = np.tanh(x @ m.w["H"] + m.w["h"])
            codes.append(h)
            pulls.append(float((np.tanh(h @ m.w["V"]) / (1 + np.exp(-(h @ m.w["U"])))) @ m.w["a"]))
        attention = [math.exp(p - max(pulls)) for p in pulls]
        z = sum(a / sum(attention) * h for a, h in zip(attention, codes)) if codes else np.zeros(len(m.w["c"]))
        assert r["score"] == pytest.approx(sigmoid(float(z @ m.w["c"] + m.w["b"])), abs=1e-3)
        assert r["weakest"] == (int(np.argmax(pulls)) if pulls else None)


def test_sample_is_bounded_in_bytes(docs, spark):
    rows = [(k, ("w" * (k + 1))) for k in range(100)] + [(200, "z" * 1_000_000)]
    labels = spark.createDataFrame([(k, 1) for k, _ in rows], "doc_id long, y int")
    got = grams.labelled_sample(docs(rows), labels, "y", 1000, most_bytes=1000).collect()
    assert sum(len(r["text"]) for r in got) <= 1000 and max(len(r["text"]) for r in got) == 44 and len(got) == 44
    tied = docs([(k, "w" * 10) for k in range(20)])
    assert grams.labelled_sample(tied, labels, "y", 1000, most_bytes=105).count() == 10
    assert grams.labelled_sample(docs(rows).where(F.lit(False)), labels, "y", 10).count() == 0
