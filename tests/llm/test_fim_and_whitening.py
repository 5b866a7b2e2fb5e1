"""Fill-in-middle by plain slices, whitening by numpy on the whole matrix."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeframe.llm import fim, whitening

TEXTS = st.text("ab\n<P>SMü😀", max_size=40)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 45), st.integers(1, 7))
def test_ropes_split_where_slices_do(text, rank, size):
    old, fim.LEAF = fim.LEAF, size
    try:
        tree = fim.rope(text)
        assert fim.text_of(tree) == text and tree[fim.POINTS] == len(text) and tree[fim.UNITS] == text.count("\n")
        a, b = fim.split(tree, rank, fim.POINTS)
        assert (fim.text_of(a), fim.text_of(b)) == (text[:rank], text[rank:])
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        a, b = fim.split(tree, rank, fim.UNITS)
        assert (fim.text_of(a), fim.text_of(b)) == ("".join(lines[:rank]), "".join(lines[rank:]))
        both = fim.concat(b, a)
        assert fim.text_of(both) == fim.text_of(b) + fim.text_of(a) and both[fim.POINTS] == len(text)
    finally:
        fim.LEAF = old


def sliced(doc_id, text, seed=7, spm=50):
    lines, h = re.findall(r"[^\n]*\n|[^\n]+", text), hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    n, h = len(lines), [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_outputs_equal_slices_and_give_the_text_back(docs):
    rng = np.random.default_rng(2)
    bits = ["line one\n", "\n", "ü 😀", "<", "P>", "<M", "last", "\r\n", "x" * 5000, "<S>"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 9), p=[0.3, 0.15, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05])) for _ in range(300)]
    texts += ["", "no end", "\n" * 30_000, "y" * 200_000, "a\n" * 9_000 + "b"]
    out = fim.fill_in_middle(docs(list(enumerate(texts))), batch_chars=20_000)
    got = {r["doc_id"]: r for r in out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()}
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == sliced(k, text)
        assert r["back"] == text


def test_odd_documents_rates_and_sentinels(odd, docs):
    rows = fim.fill_in_middle(odd).collect()
    want = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    tell = lambda i, t: (i, *sliced("" if i is None else i, t))
    assert sorted(map(tuple, rows), key=repr) == sorted((tell(r["doc_id"], r["t"]) for r in want), key=repr)
    assert fim.fill_in_middle(odd.limit(0)).count() == 0
    some = docs([(k, f"a {k}\nb\nc") for k in range(400)])
    few = fim.fill_in_middle(some, fim_percent=30, spm_percent=0, sentinels=("[pre]", "[suf]", "[mid]"))
    counts = {r["form"]: r["count"] for r in few.groupBy("form").count().collect()}
    assert set(counts) == {"plain", "psm"} and 80 < counts["psm"] < 160
    back = few.select("doc_id", fim.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in back.collect()} == {k: f"a {k}\nb\nc" for k in range(400)}
    for bad in (("<a>", "<a>", "<b>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("<a>", "a", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(some, sentinels=bad)


def by_numpy(x, k):
    """(deviation, whitened, explained) of whole-number vectors."""
    n, s = len(x), x.astype(object).sum(0)
    deviation = [int(v) for v in ((n * x.astype(object) - s) ** 2).sum(1)]
    c = (n * x.astype(object) - s).astype(float) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return deviation, c @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def whole(x):
    return np.floor(1024 * x.astype(float)).astype(np.int64) + 100_000


def gathered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening_equals_numpy(spark, kind):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(700, 24)) @ rng.normal(size=(24, 24)) + 3).astype(np.float32 if kind == "float" else float)
    x[3] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(7)
    got = gathered(whitening.whiten(df))
    deviation, white, explained = by_numpy(whole(x), 8)
    assert set(got) == set(range(700)) and all(set(c) == set(range(1, 9)) for c in got.values())
    mine = np.array([[got[i][c]["whitened"] for c in range(1, 9)] for i in range(700)])
    signs = np.sign((mine * white).sum(0))
    assert np.abs(mine - signs * white).max() < 1e-9
    assert [got[i][1]["deviation"] for i in range(700)] == deviation
    assert [got[0][c]["explained"] for c in range(1, 9)] == pytest.approx(explained.tolist(), rel=1e-9)
    assert got[5][2]["n"] == 700 and 0 <= got[5][2]["identity_error"] < 1e-9
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(8)).max() < 1e-9


def test_offsets_far_from_zero_keep_their_digits(spark):
    """Entries near a million with a spread of one: centring after multiplying would lose half the digits."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)) * np.arange(1, 7) + 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, (_, white, explained) = gathered(whitening.whiten(df, components=3)), by_numpy(whole(x), 3)
    mine = np.array([[got[i][c]["whitened"] for c in (1, 2, 3)] for i in range(400)])
    assert np.abs(mine - np.sign((mine * white).sum(0)) * white).max() < 1e-9
    assert [got[0][c]["explained"] for c in (1, 2, 3)] == pytest.approx(explained.tolist(), rel=1e-9)


def test_vectors_that_take_no_part_and_spaces_of_few_dimensions(spark):
    rng = np.random.default_rng(4)
    plane = rng.normal(size=(50, 2)) @ rng.normal(size=(2, 5)) * 64
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(plane) / 1024)] + [(None, [1.0] * 5), (7, [1.0] * 5), (7, [1.0] * 5)]
    bad = [(90, None), (91, [None, 1.0, 1.0, 1.0, 1.0]), (92, [float("nan")] * 5), (93, [float("inf")] * 5), (94, [1.0]), (95, [])]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows + bad, schema).withColumn("component", F.lit("clash")).withColumn("n", F.lit("clash"))
    out = whitening.whiten(df).collect()
    assert {r["vec_id"] for r in out} == set(range(50)) | {None, 7}
    assert sum(r["vec_id"] == 7 and r["component"] == 1 for r in out) == 3 and {r["n"] for r in out} == {53}
    assert all(r["identity_error"] < 1e-6 for r in out) and sum({r["component"]: r["explained"] for r in out}.values()) == pytest.approx(1, abs=1e-9)
    assert max(r["component"] for r in out) <= 5
    for none in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 7 and embedding[0] = 1"), df.where("vec_id >= 90")):
        assert whitening.whiten(none).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], schema)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}


def test_entries_beyond_a_long(spark):
    df = spark.createDataFrame([(i, [1e200 * (-1) ** i, float(i)]) for i in range(10)], "vec_id long, embedding array<double>")
    out = whitening.whiten(df).collect()
    assert {r["component"] for r in out} == {1} and all(r["deviation"] is None and abs(r["whitened"]) == pytest.approx(1) for r in out)
