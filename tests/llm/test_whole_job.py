"""Cases in which an earlier version of an operator did less than the whole job."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodeframe.llm import decontamination, grams, mixing, simhash, substring


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def pairs_of(rng, n, low, high):
    """Pairs of texts whose similarity lies from ``low`` to below ``high``."""
    out = []
    word = lambda: f"w{rng.randrange(1_000_000)}"
    while len(out) < n:
        size, goal = rng.randrange(60, 400), rng.uniform(low, high)
        tail = round(size * (1 - goal) / (1 + goal))
        head = [word() for _ in range(size + 4 - tail)]
        a, b = (" ".join(head + [word() for _ in range(tail)]) for _ in range(2))
        if low <= jaccard(a, b) < high:
            out.append((a, b))
    return out


def test_pairs_above_the_similarity_are_found_and_none_below(docs):
    rng = random.Random(3)
    above, below = pairs_of(rng, 400, 0.80, 0.85), pairs_of(rng, 400, 0.70, 0.80)
    rows = [(k, t) for k, t in enumerate(t for pair in above + below for t in pair)]
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(docs(rows)).collect()}
    assert {k for k, _ in rows if not k % 2} <= kept
    found = sum(2 * k + 1 not in kept for k in range(400))
    assert found >= 0.98 * 400
    assert all(2 * k + 1 in kept for k in range(400, 800))


def test_equal_fingerprints_do_not_link_different_texts(docs):
    rng = random.Random(4)
    line = "one two three four five " * 200
    rows = [(k, line + " ".join(f"w{rng.randrange(1_000_000)}" for _ in range(200))) for k in range(2)]
    assert jaccard(rows[0][1], rows[1][1]) < 0.1
    assert {r["doc_id"] for r in simhash.keep_one_of_each(docs(rows)).collect()} == {0, 1}


def test_large_groups_are_compared_in_cells(spark, docs):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12))]) for _ in range(40)]
    rows = list(enumerate(texts)) + [(100 + k, t) for k, t in enumerate(texts[:5])]
    df = docs(rows)
    prints = {r["print"]: r["doc_id"] for r in simhash.banded(df.where("doc_id < 100"), 5).collect()}
    candidates = spark.createDataFrame([(p, 1, 60) for p in prints], "print long, root long, n int")
    root = {k: k for k in range(40)}
    for a in range(40):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    for limit in (4_000, 10):
        got = {k: k for k in range(40)}
        for r in simhash.jaccard_links(df, candidates, 5, 0.8, group_rows=limit).collect():
            old, new = sorted((got[prints[r["a"]]], got[prints[r["b"]]]), reverse=True)
            got = {k: new if v == old else v for k, v in got.items()}
        assert got == root


def leaked(spark, docs, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["identical"] for r in decontamination.leaks(docs(list(enumerate(texts))), bench).collect()}


def test_short_items_match_whole(spark, docs):
    items = ["tiny", "What is 12 times?", "Boston Red Sox", ""]
    texts = ["so tiny that", "He asked: what is 12 times? Then left.", "what is 13 times", "the Boston Red Sox Club", "red sox of boston", ""]
    assert leaked(spark, docs, items, texts) == {(0, 0): True, (1, 1): True, (3, 2): True}


def test_reparameterised_names_numbers_and_units_leak(spark, docs):
    items = [
        "Natalia sold 48 clips in April. Natalia sold half as many clips in May. How many clips did Natalia sell altogether?",
        "The road from Boston to the sea is 25 miles long and a cart takes four days for it, so how far is one day from Boston?",
        "A farmer loads 5kg of grain on a cart and then adds another 12kg of hay, so what weight does the old cart carry now?",
    ]
    before = "Nothing of this is asked. "
    texts = [
        before + items[0].replace("Natalia", "Kevin"),
        before + items[1].replace("Boston", "New York").replace("25", "twenty five"),
        before + items[2].replace("5kg", "7kg").replace("12kg", "30 kg"),
    ]
    got = leaked(spark, docs, items, texts)
    assert got == {(0, 0): False, (1, 1): False, (2, 2): False}


def test_first_word_changed_in_one_sentence_still_leaks(spark, docs):
    item = "The cat sat on the mat all day while it rained outside the house. The dog slept near the warm fire and dreamed of bones until the evening came."
    assert leaked(spark, docs, [item], [item.replace("The dog", "A dog")]) == {(0, 0): True}


def test_repeated_ids_do_not_swell_the_sample(spark, docs):
    rows = [(k, f"text {k}") for k in range(200)] + [(7, f"text 7 {k}") for k in range(400)]
    labels = spark.createDataFrame([(k % 200, k % 2) for k in range(600)] + [(7, 1)] * 500, "doc_id long, quality int")
    got = [(r["doc_id"], r["label"]) for r in grams.labelled_sample(docs(rows), labels, "quality", 320).collect()]
    assert len(got) == len(set(got)) and {label for _, label in got} == {0, 1}
    assert sum(k == 7 for k, _ in got) == 1


QUESTION = "Natalia sold 48 clips to her friends in April and then sold half as many clips in May, how many clips did she sell?"


def test_rows_that_share_an_id_or_have_none_are_judged_each(spark, docs):
    """An exact copy and a re-parameterised one under one id, and under no id: their values clash, but not within a row."""
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    other = QUESTION.replace("48", "52").replace("Natalia", "Kevin")
    got = lambda rows: sorted((r["doc_id"], r["share"], r["identical"]) for r in decontamination.leaks(docs(rows), bench).collect())
    assert got([(1, QUESTION), (2, other)]) == [(1, 1.0, True), (2, 1.0, False)]
    assert got([(7, QUESTION), (7, other), (7, "nothing at all")]) == [(7, 1.0, True)] and got([(7, other), (7, other)]) == [(7, 1.0, False)]
    assert got([(None, QUESTION), (None, other)]) == [(None, 1.0, True)]
    rows = docs([(7, QUESTION), (7, other), (None, other), (7, "nothing at all"), (None, None)])
    assert {r["text"] for r in decontamination.without_leaks(rows, bench).collect()} == {"nothing at all", None}


def test_items_of_one_id_are_judged_each(spark, docs):
    second = "The road from the old harbour to the northern lighthouse takes a cart four days in dry weather."
    bench = spark.createDataFrame([(1, QUESTION), (1, second), (1, second), (None, QUESTION)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs([(1, QUESTION), (2, second)]), bench).collect()), key=repr)
    assert got == [(1, 1), (1, None), (2, 1)]


def test_a_window_that_everything_has_pairs_nothing_and_loses_nothing(spark, docs):
    """All items and all documents share a preamble; only documents that hold an item's own words are paired with it."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    common = "please answer the following question as well as you can"
    own = [[word() for _ in range(20)] for _ in range(40)]
    items = [f"{common} {' '.join(w)}" for w in own]
    texts = [f"{common} {' '.join(own[k][:16]) if k % 2 else ' '.join(own[k])} {word()}" if k < 40 else f"{common} {word()} {word()}" for k in range(300)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in decontamination.leaks(docs(list(enumerate(texts))), bench).collect()}
    assert set(got) == {(k, k) for k in range(40)} and all(got[k, k] == 1 for k in range(0, 40, 2)) and all(0.8 <= got[k, k] < 0.9 for k in range(1, 40, 2))


def test_both_sieves_lose_no_hash(spark):
    rng = np.random.default_rng(3)
    known = rng.integers(-(2**63), 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(h),) for h in known], "hash long")
    h = np.concatenate([known, rng.integers(-(2**63), 2**63 - 1, 50_000)]).view(np.uint64)
    exact, field = decontamination.sieve_of(df, 10_000), decontamination.sieve_of(df, 100, bits=17)
    assert exact.places(h).tolist() == list(range(5000))
    assert set(range(5000)) <= set(field.places(h).tolist()) and len(field.places(h)) < 5000 + 1000


def test_repeated_rows_are_dealt_to_all_shards_of_their_source(spark, docs):
    rows = [(1, "the same words again and again")] * 3000 + [(k, f"row {k} has words of its own") for k in range(2, 3002)]
    drawn = mixing.mix(docs(rows), block_tokens=4, shard_docs=500).cache()
    sizes = [r["count"] for r in drawn.groupBy("shard").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 500
    total = drawn.agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max(F.col("taken") / F.col("size")).alias("m")).first()
    assert abs(total["t"] - total["g"]) <= 0.01 * total["g"] and total["m"] <= 2
    mixed = mixing.mixed_documents(docs(rows), block_tokens=4, shard_docs=500)
    assert mixed.agg(F.sum(mixing.token_count(F.col("text")))).first()[0] == total["t"]


def test_repeated_rows_of_different_other_columns_are_mixed_each(docs):
    rows = [(1, "one two three", "a")] * 5 + [(1, "one two three", "b")] * 5 + [(1, "one two three", "a", "fr")] * 5 + [(2, "four five", "b")]
    df = docs(rows)
    got = mixing.mixed_documents(df, block_tokens=1)
    taken = {r["source"]: r["t"] for r in mixing.mix(df, block_tokens=1).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert {r["source"]: r["t"] for r in got.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("t")).collect()} == taken
    assert {(r["source"], r["lang"]) for r in got.where("doc_id = 1").select("source", "lang").distinct().collect()} == {("a", "en"), ("a", "fr"), ("b", "en")}


def test_copies_of_one_row_reach_the_automata_once(docs, monkeypatch):
    """Many rows equal in id and text beside later documents that hold their words: what is judged does not grow with them."""
    rng = random.Random(5)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    late = [(9, " ".join(passage[:60] + ["end"])), (8, " ".join(["start", *passage[30:100]]))]
    seen, judge = [], substring._judge_shards
    monkeypatch.setattr(substring, "_judge_shards", lambda rows, window: seen.append(rows.count()) or judge(rows, window))
    results = []
    for copies in (1, 2000):
        rows = [(3, " ".join(passage))] * copies + late + [(9, late[0][1])] * (copies - 1)
        out = substring.deduplicate(docs(rows)).collect()
        assert len(out) == len(rows)
        results.append({(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out})
    assert results[0] == results[1] and seen[0] == seen[1]
    assert {(i, n, k) for i, n, k, _ in results[0]} == {(3, 120, 0), (9, 61, 60), (8, 71, 70)}


def test_many_classes_are_bounded(docs, spark):
    rows = [(k, f"text {k}") for k in range(3000)]
    labels = spark.createDataFrame([(k, f"l{k}") for k in range(2000)] + [(k, "common") for k in range(2000, 3000)], "doc_id long, lang string")
    got = grams.labelled_sample(docs(rows), labels, "lang", 50, most=100, most_classes=10).collect()
    assert len({r["label"] for r in got}) <= 10 and "common" in {r["label"] for r in got} and len(got) <= 60
