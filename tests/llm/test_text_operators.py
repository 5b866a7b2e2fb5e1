"""Operators on documents against brute-force versions and on odd inputs."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeframe.llm import decontamination, grams, langid, mixing, packing, quality, simhash, substring, toxicity
from lodeframe.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def babble(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# Mixing


def fill(sizes, weights, share, ceiling):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > ceiling * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = ceiling * sizes[s]
            rest -= target[s]
            free.discard(s)
    return target | {s: rest * w[s] / sum(w[x] for x in free) for s in free}


def test_mix_meets_targets(docs):
    rng = random.Random(2)
    rows = [(k, babble(rng, rng.randrange(1, 300)), rng.choice(["a", "a", "a", "a", "b", "c", "d", "é", None])) for k in range(600)]
    df = docs(rows)
    got = mixing.mix(df, shard_docs=50).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text))
    want, taken = fill(sizes, (5, 2, 1), 1.5, 2.0), defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64 * 8 + 0.01 * want[s]
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7), shard_docs=50).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


@pytest.mark.parametrize("held", [3, 100_000])
def test_targets_of_many_sources(spark, held):
    """The level is found in stretches of a list too long to be held, as in one that is held."""
    rng = random.Random(9)
    sizes = {f"s{k:04d}": rng.choice([0, 1, 7, rng.randrange(1, 10**6)]) for k in range(700)} | {None: 50}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = fill(sizes, (5, 2, 1), 1.5, 2.0)
    got = {r["source"]: (r["target"], r["source_no"]) for r in mixing.source_targets(df, (5.0, 2.0, 1.0), 1.5, 2.0, held).collect()}
    assert {s: t for s, (t, _) in got.items()} == pytest.approx(want)
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1][1])] == sorted(s for s in sizes if s) + [None]


def test_a_small_source_meets_its_target_with_small_blocks(docs):
    rows = [(k, "w " * 40, "big") for k in range(200)] + [(500, "x " * 30, "small")]
    got = [r for r in mixing.mix(docs(rows), block_tokens=16).collect() if r["source"] == "small"]
    assert abs(got[0]["taken"] - got[0]["target"]) <= 16


def test_columns_with_names_of_inner_ones_come_back_as_they_were(spark, docs):
    rng = random.Random(10)
    df = docs([(k % 25, babble(rng, 40) if k < 25 else "same words in some of the rows here", rng.choice("ab")) for k in range(30)])
    names = ["__id", "__spread", "__copy", "__whole", "__words", "__size", "__taken", "__print", "__place", "__key", "__hit", "root", "node"]
    df = df.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    bench = spark.createDataFrame([(1, "same words in some of the rows here")], "item_id long, text string")
    for out in (mixing.mixed_documents(df), simhash.keep_one_of_each(df), decontamination.without_leaks(df, bench)):
        assert out.columns == df.columns
        held = out.collect()
        assert held and all(r[n] == f"{n}{r['doc_id']}" for r in held for n in names)


def test_sainte_lague_equals_seat_by_seat(spark):
    rng = random.Random(5)
    votes = [rng.choice([0.0, 1.0, 7.5, rng.uniform(0, 1000)]) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(votes)), "party long, votes double")
    for seats in (0, 1, 24, 300):
        quota = [0] * len(votes)
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda k: (votes[k] / (2 * quota[k] + 1), -k))
            quota[best] += 1
        got = {r["party"]: r["quota"] for r in mixing.sainte_lague(df, seats).collect()}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in enumerate(quota) if v}


def test_mix_of_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] == 0 for r in got if not r["size"])
    assert mixing.mix(odd.limit(0)).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.where("text is null or trim(text) = ''").count() == 0
    assert mixing.mixed_documents(odd.limit(0)).count() == 0


def test_mixed_documents_hold_what_is_taken(docs):
    rng = random.Random(8)
    df = docs([(k, babble(rng, rng.randrange(1, 200)), rng.choice("abc")) for k in range(200)])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df, block_tokens=32).collect()}
    held = defaultdict(int)
    for r in mixing.mixed_documents(df, block_tokens=32).collect():
        held[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert dict(held) == {k: v for k, v in taken.items() if v}


# Near-duplicates


def brute_fingerprint(text, shingle):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, budget):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(docs):
    rng = random.Random(1)
    rows, k = [], 0
    for _ in range(40):
        base = babble(rng, rng.randrange(1, 200)).split()
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "EDIT"
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "É A b C")]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(rows)).collect()}
    prints = {i: brute_fingerprint(t, 4) for i, t in rows}
    roots = brute_components(prints, 4)
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i, _ in rows}


@pytest.mark.parametrize("group_rows", [20_000, 30])
@pytest.mark.parametrize("budget", [0, 3, 4])
def test_trie_join_of_crowded_fingerprints(spark, budget, group_rows):
    rng = random.Random(budget)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {rng.getrandbits(64) for _ in range(60)}
    for c in centres:
        for _ in range(60):
            v = c
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    points = spark.createDataFrame([(signed(v), signed(v)) for v in values], "fp long, rep long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.hamming_links(points, budget, group_rows)).collect()}
    by_value = sorted(values, key=signed)
    label = {v: v for v in by_value}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, a in enumerate(by_value):
        for b in by_value[i + 1 :]:
            if bin(a ^ b).count("1") <= budget:
                x, y = find(a), find(b)
                if x != y:
                    label[max(x, y, key=signed)] = min(x, y, key=signed)
    assert {signed(v): roots.get(signed(v), signed(v)) for v in by_value} == {signed(v): signed(find(v)) for v in by_value}


def test_near_duplicates_of_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[None] == 4 and by_id[7] == 6
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
    only_null = simhash.keep_one_of_each(odd.where("doc_id is null"))
    assert only_null.count() == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}


# Substrings


def brute_substrings(rows, window):
    first = {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {k for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < i for k in range(s, s + window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("shard", [4000, 3])
def test_substrings_equal_brute_force(docs, shard):
    rng = random.Random(6)
    passages = [babble(rng, rng.randrange(10, 90), 30).split() for _ in range(6)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            p = list(rng.choice(passages)) if rng.random() < 0.6 else babble(rng, rng.randrange(1, 60), 30).split()
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "EDIT"
            words += p
        rows.append((k, "  ".join(words)))
    rows += [(98, "a " * 300), (99, "a " * 200), (97, None), (96, "")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate(docs(rows), 20, 7, shard).collect()}
    assert got == brute_substrings(rows, 20)
    alone = substring.deduplicate(docs(rows), 20, 7, shard, collapse=False).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in alone} == got


def test_substrings_of_odd_rows(odd):
    got = substring.deduplicate(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got}
    assert by_id[6] == (30_000, 0) and by_id[7] == (30_000, 30_000) and by_id[None] == (7, 0)
    assert substring.deduplicate(odd.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=14), max_size=5), st.text("ab", max_size=14), st.integers(1, 6))
def test_automaton_spans(references, query, least):
    automaton = substring.SuffixAutomaton()
    for r in references:
        automaton.add(list(r))
    spans, whole = automaton.spans(list(query), least)
    known = lambda s: any(s in r for r in references)
    want = {k for i in range(len(query)) for j in range(i + least, len(query) + 1) if known(query[i:j]) for k in range(i, j)}
    assert {k for a, b in spans for k in range(a, b)} == want
    assert whole == (not query or known(query))


# Decontamination


def test_reparameterised_questions_leak(spark, docs):
    items = [(1, "If a train leaves Boston at 9 am and travels 120 km in 3 hours, how fast does the train go on average?"), (2, "The quick brown fox jumps over the lazy dog near the quiet river bank today."), (3, None), (4, "tiny"), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = "Some other words stand before this and nothing here matters to anyone at all. "
    texts = {
        10: filler + items[0][1] + " And after.",
        11: filler + items[0][1].replace("Boston", "Madrid").replace("120", "450").replace("3 hours", "5 hours"),
        12: filler + "The quick brown fox jumps over",
        13: filler,
        14: items[1][1].upper(),
        15: None,
        16: "so tiny that",
    }
    got = {(r["doc_id"], r["item_id"]): r["identical"] for r in decontamination.leaks(docs(list(texts.items())), bench).collect()}
    assert got == {(10, 1): True, (11, 1): False, (14, 2): True, (16, 4): True}
    kept = decontamination.without_leaks(docs(list(texts.items())), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [12, 13, 15]


def test_slots_must_be_consistent(spark, docs):
    bench = spark.createDataFrame([(1, "we add 7 to the sum of 7 and the rest of 7 to get what number at the end")], "item_id long, text string")
    rows = [(1, "we add 5 to the sum of 5 and the rest of 5 to get what number at the end"), (2, "we add 5 to the sum of 6 and the rest of 8 to get what number at the end")]
    assert [r["doc_id"] for r in decontamination.leaks(docs(rows), bench).collect()] == [1]


def test_many_windows_go_through_the_join(spark, docs):
    rng = random.Random(3)
    texts = [babble(rng, 40) for _ in range(30)]
    bench = spark.createDataFrame(list(enumerate(texts[:10])), "item_id long, text string")
    rows = docs([(k, t) for k, t in enumerate(texts)])
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(decontamination.leaks(rows, bench)) == key(decontamination.leaks(rows, bench, sieve_limit=0))
    assert decontamination.leaks(rows, bench).count() == 10


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "One two three four five six seven.")], "item_id long, text string")
    got = decontamination.leaks(odd, bench).collect()
    assert {r["doc_id"] for r in got} == {4, None}
    assert decontamination.leaks(odd, bench.limit(0)).count() == 0 and decontamination.leaks(odd.limit(0), bench).count() == 0
    kept = decontamination.without_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3


# Learned scores


@pytest.fixture(scope="module")
def labelled(spark, docs):
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(400):
        bad, toxic = k % 4 == 0, k % 3 == 0
        words = babble(rng, rng.randrange(20, 200), 3000).split()
        words = [w + ("." if rng.random() < 0.1 else "") for w in words]
        if bad:
            words = [w.upper() + "!!" for w in words[:20]] * 5
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyword"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (9999, 1, 1), (5, None, None)]
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(labelled, odd):
    documents, labels = labelled
    model = quality.fit(documents, labels.where(~grams.held_out(4, 2)))
    got = quality.score(documents, model).join(labels, "doc_id").where(grams.held_out(4, 2) & F.col("quality").isNotNull()).collect()
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in got]) >= 0.97
    rest = quality.score(odd, model).collect()
    assert len(rest) == odd.count() and all(0 <= r["score"] <= 1 for r in rest)
    kept = quality.accepted(documents, model)
    assert kept.columns == documents.columns and 250 < kept.count() < 320
    assert quality.accepted(odd, model, 0.0).count() == odd.count() and quality.score(odd.limit(0), model).count() == 0
    same = quality.fit(documents.repartition(5), labels.where(~grams.held_out(4, 2)))
    assert all(np.allclose(model.w[k], same.w[k]) for k in model.w)


def test_quality_without_labels_is_a_prior(labelled):
    documents, labels = labelled
    model = quality.fit(documents, labels.limit(0))
    assert all(0 <= r["score"] <= 1 for r in quality.score(documents, model).take(5))


def test_attention_sums_to_one_and_gradient_is_right(labelled):
    rng = np.random.default_rng(0)
    x, pieces, y = rng.normal(size=(9, quality.PASSAGE_FEATURES)), np.array([2, 0, 4, 3]), np.array([1.0, 0, 1, 0])
    w = {"H": rng.normal(size=(quality.PASSAGE_FEATURES, 4)), "h": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "c": rng.normal(size=4), "b": np.array(0.1)}
    model = quality.QualityModel(np.zeros(quality.PASSAGE_FEATURES), np.ones(quality.PASSAGE_FEATURES), w)
    f = model.forward(x, pieces)
    assert np.allclose(np.bincount(f["bag"], f["attention"], minlength=4)[pieces > 0], 1)
    grads = quality._gradients(model, f, y, np.ones(4))
    loss = lambda: -np.mean(y * np.log(model.forward(x, pieces)["score"]) + (1 - y) * np.log(1 - model.forward(x, pieces)["score"])) + sum(0.5e-4 * np.sum(v * v) for v in model.w.values())
    for k in ("H", "V", "U", "a", "c"):
        at = (0,) * w[k].ndim
        keep = w[k][at]
        w[k][at] = keep + 1e-5
        up = loss()
        w[k][at] = keep - 1e-5
        down = loss()
        w[k][at] = keep
        assert grads[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_toxicity_finds_documents_and_sentences(labelled, odd):
    documents, labels = labelled
    model = toxicity.fit(documents, labels.where(~grams.held_out(3, 1)))
    got = toxicity.score(documents, model).join(labels, "doc_id").join(documents.select("doc_id", "text"), "doc_id").where(grams.held_out(3, 1) & F.col("toxic").isNotNull()).collect()
    assert np.mean([(r["score"] >= 0.7) == (r["toxic"] == 1) for r in got]) >= 0.95
    for r in got:
        for s in r["sentences"]:
            if r["toxic"]:
                assert re.search("vileword|nastyword", r["text"].lower().encode()[s["start"] : s["end"]].decode())
    rest = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert rest[1] == rest[2] == rest[3] == 0.0 and toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).count() == odd.count()


def test_noisy_or_is_one_minus_the_product(labelled):
    documents, labels = labelled
    model = toxicity.fit(documents, labels)
    rows = toxicity.score(documents, model, 0.0).take(30)
    for r in rows:
        assert r["score"] == pytest.approx(1 - np.prod([1 - s["score"] for s in r["sentences"]]), abs=1e-9)


def test_languages(docs, odd):
    rng = random.Random(7)
    parts = {"xa": ["ko", "ta", "ri"], "xb": ["sch", "ung", "ei"], "xc": ["eau", "oix", "é"], "xd": ["zh", "qq", "vv"], "xe": ["mi", "no", "pu"]}
    rows = []
    for k in range(500):
        lang = list(parts)[k % 5]
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randrange(3, 60))), "a", lang))
    df = docs(rows)
    model = langid.fit(df.where(~grams.held_out(3, 1)))
    assert model.code.shape == (5, 15)
    got = langid.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").where(grams.held_out(3, 1)).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    rest = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert rest[1] == rest[2] == rest[3] == ("und", 0.0) and rest[4][0] in parts
    nothing = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df.limit(3), nothing).collect()} == {"und"}
    single = langid.fit(df.where("lang = 'xa'"))
    assert {r["lang_pred"] for r in langid.identify(df.limit(3), single).collect()} == {"xa"}


def test_codewords_stay_apart():
    for n in (2, 3, 6, 12):
        code = langid.codewords(n)
        assert min(np.sum(code[i] != code[j]) for i in range(n) for j in range(i)) >= 1


# Packing


def brute_best_fit(sizes, room):
    rows = []
    for item in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [(r[0] - sizes[item], k) for k, r in enumerate(rows) if r[0] >= sizes[item]]
        if fits:
            k = min(fits)[1]
            rows[k][0] -= sizes[item]
            rows[k][1].append(item)
        else:
            rows.append([room - sizes[item], [item]])
    return rows


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_decreasing(sizes):
    got = packing.best_fit_decreasing(sizes, 32)
    assert sorted(i for r in got for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 32 for r in got)
    want = brute_best_fit(sizes, 32)
    assert sorted(sum(sizes[i] for i in r) for r in got) == sorted(32 - r[0] for r in want)


def test_packed_rows_restore_every_document(docs, odd):
    rng = random.Random(11)
    rows = [(k, babble(rng, rng.choice([1, 5, 80, 900]))) for k in range(80)] + [(90, "<|endoftext|> é 漢字 \U0001f600"), (91, ""), (92, None)]
    got = packing.pack(docs(rows), 128, group_tokens=3000).collect()
    encode, pieces = packing.tokenizer(packing.VOCABULARY), defaultdict(list)
    for r in got:
        ids, positions = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(positions) == 128 and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == packing.END_OF_TEXT).all()
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            pieces[doc].append((start, ids[a:b]))
            assert positions[a:b].tolist() == list(range(b - a))
    restored = {}
    for doc, held in pieces.items():
        tokens = np.concatenate([t for _, t in sorted(held, key=lambda p: p[0])]).tolist()
        assert tokens[-1] == packing.END_OF_TEXT
        restored[doc] = encode.decode(tokens[:-1])
    assert restored == {i: t for i, t in rows if t}
    assert packing.pack(odd).agg(F.sum("n_tokens")).first()[0] > 30_000 and packing.pack(odd.limit(0)).count() == 0


def test_packed_rows_are_written_as_they_are(spark, docs, tmp_path):
    packed = packing.pack(docs([(k, "some words to pack " * 30) for k in range(9)]), 256)
    packing.write_packed(packed, str(tmp_path / "packed"))
    key = lambda d: sorted(map(tuple, d.select("shard", "row", "n_tokens", "ids").collect()))
    assert key(spark.read.parquet(str(tmp_path / "packed"))) == key(packed)
    r, none = packing.fill(packed).first(), packing.fill(packed.limit(0)).first()
    assert r["share"] == pytest.approx(r["tokens"] / (256 * r["rows"])) and tuple(none) == (0, 0, None)
