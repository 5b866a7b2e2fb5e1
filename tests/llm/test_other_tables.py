"""Nearest neighbours and chat formatting."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeframe.llm import chat, neighbours


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        out[q] = sorted((float(s), i) for s, i in zip(d, ids) if i != q)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def test_recall_on_vectors_without_structure(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = found(neighbours.nearest(df, F.col("vec_id") % 100 == 0, range_rows=500, cell_queries=5))
    want = brute(list(range(3000)), x.astype(float), range(0, 3000, 100))
    assert all(len(v) == 10 for v in got.values()) and set(got) == set(want)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
    for q, rows in got.items():
        assert [s for s, _ in rows] == sorted(s for s, _ in rows)
        for s, i in rows:
            assert s == pytest.approx(np.sqrt(((x[q].astype(float) - x[i].astype(float)) ** 2).sum()), rel=1e-12)


def test_windows_on_clustered_vectors_are_narrow_and_recall_holds(spark, monkeypatch):
    """Blobs of a few dimensions, one with a third of all rows: a query is compared with a few percent of them."""
    rng, n = np.random.default_rng(6), 8000
    centres, spans = rng.normal(size=(80, 32)), rng.normal(size=(80, 3, 32)) * 0.1
    who = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 80, n))
    x = centres[who] + np.einsum("nd,ndk->nk", rng.normal(size=(n, 3)), spans[who])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    chosen, windows = [], neighbours.windows
    monkeypatch.setattr(neighbours, "windows", lambda *a: chosen.append(windows(*a)) or chosen[-1])
    got = found(neighbours.nearest(df, F.col("vec_id") % 100 == 0, range_rows=512, least_reach=32))
    want = brute(list(range(n)), x, range(0, n, 100))
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
    curves, reach = chosen[0]
    assert curves * (2 * reach + 1) < 0.15 * n


def test_windows_take_the_least_work():
    apart = np.array([[5, 900], [900, 6], [7, 8], [9, 1]])
    assert neighbours.windows(apart, 10_000, 1.0, 1) == (2, 7) and neighbours.windows(apart[:, :1], 1000, 1.0, 1) == (1, 1000)
    assert neighbours.windows(np.zeros((0, 2)), 50, 0.9, 1) == (1, 50) and neighbours.windows(apart, 10_000, 0.5, 20)[1] == 20


def test_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]
    rows += [(200, None), (300, [0.0] * 4), (400, [1.0, None, 2.0, 3.0]), (500, [float("nan")] * 4), (600, [float("inf"), 0.0, 0.0, 0.0]), (700, [1.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = found(neighbours.nearest(df, F.col("vec_id") % 100 == 0))
    good = [(i, v) for i, v in rows if i is not None and i < 200]
    want = brute([i for i, _ in good], np.array([v for _, v in good]), [0, 100])
    assert set(got) == {0, 100}
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = found(neighbours.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0))
    assert len(few[0]) == 2


@pytest.mark.parametrize("offset,scale", [(0, 1), (1e8, 1), (1e12, 1), (0, 1e200), (0, 1e-200), (1e15, 1)])
def test_neither_offset_nor_magnitude_costs_a_neighbour(offset, scale):
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(3000, 64)) + offset) * scale
    x[1500:] -= 3 * offset * scale  # two groups far apart, so that no centre serves both
    point, hidden = rng.permutation(3000), rng.random((40, 3000)) < 0.3
    q, p, d = neighbours._closest(x[:40], x, point, hidden, 11)
    for k in range(40):
        true = np.sqrt((((x - x[k]) / scale) ** 2).sum(1)) * scale
        seen = np.flatnonzero(~hidden[k])
        want = seen[np.lexsort((point[seen], true[seen]))][:11]
        assert d[q == k] == pytest.approx(true[want], rel=1e-12) and set(p[q == k]) == set(point[want])


def test_fewer_points_than_asked_for_and_hidden_ones():
    x, point = np.arange(6.0).reshape(3, 2), np.array([5, 4, 3])
    q, p, d = neighbours._closest(x, x, point, np.eye(3, dtype=bool), 10)
    assert q.tolist() == [0, 0, 1, 1, 2, 2] and p.tolist() == [4, 3, 3, 5, 4, 5]
    assert neighbours._closest(x, x, point, np.ones((3, 3), bool), 2)[0].tolist() == [] and neighbours._closest(x[:0], x, point, None, 2)[2].tolist() == []
    far = np.array([[1.7e308, 0.0], [-1.7e308, 0.0], [0.0, 0.0]])
    assert neighbours._closest(far[:1], far, point, None, 3)[1].tolist() == [5, 3, 4]


@pytest.mark.parametrize("offset,scale", [(1e9, 1.0), (0.0, 1e200)])
def test_search_of_far_and_of_large_vectors(spark, offset, scale):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(600, 8)) + offset) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(neighbours.nearest(df, F.col("vec_id") % 50 == 0, range_rows=100))
    want = brute(list(range(600)), x / scale, range(0, 600, 50))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


def test_hilbert_neighbours_are_one_step_apart():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = neighbours.hilbert_keys(side, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = side[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def digest(turns):
    return hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "#", ""]), st.text("\\#/:<>turn \n", max_size=12)), min_size=1, max_size=4), min_size=1, max_size=20))
def test_round_trip(spark, chats):
    rows = [(c, t, role, text) for c, turns in enumerate(chats) for t, (role, text) in enumerate(turns)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = out.select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in back.collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == chats[r["conv_id"]]
        assert r["loss"] == "".join(text for role, text in chats[r["conv_id"]] if role == "assistant")


def test_plain_texts_stay_as_they_are_and_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a </turn>\n b"), (2, 0, "user", "plain ## text")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[2]["formatted"] == "### user: plain ## text</turn>\n" and not got[2]["escaped"] and got[1]["escaped"]
    assert got[1]["formatted"].count("</turn>\n") == 2


def test_a_conversation_of_very_many_turns(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id").cast("string"), F.when(F.col("id") == 777, " ## </turn>\n").otherwise("")).alias("text"))
    out = chat.format_chats(rows).select("n_turns", "escaped", F.size("loss_spans").alias("spans"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), chat.parse(F.col("formatted"))[n - 1]["text"].alias("last")).first()
    assert (out["n_turns"], out["spans"], out["escaped"], out["last"]) == (n, n // 2, True, f"turn {n - 1}")
    assert out["loss"] == "".join(f"turn {k}" + (" ## </turn>\n" if k == 777 else "") for k in range(1, n, 2))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 16, 17, 30])
def test_running_starts_in_blocks(spark, n):
    lengths = [(7 * k) % 5 + 1 for k in range(n)]
    df = spark.createDataFrame([(lengths,)], "a array<int>")
    assert df.select(chat.running_starts(F.col("a"), 4).alias("s")).first()["s"] == [1 + sum(lengths[:k]) for k in range(n)]


def test_odd_conversations(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, 0, "assistant", "x"), (2, 5, "assistant", "long " * 50_000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("turns", F.lit(1))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.format_chats(df).select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("user", "first"), ("", ""), ("assistant", ""), ("assistant", "")], None: [("assistant", "x")], 2: [("assistant", "long " * 50_000)]}
    assert chat.format_chats(df.limit(0)).count() == 0
