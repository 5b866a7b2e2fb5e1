"""Leaks against plain Python that tries every alignment of every item in every document, on generated questions."""

import random
import re

from lodeframe.llm import decontamination as dc

NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"


def tokens(text):
    """(kind or None, value, capital, ends, mark) of every word; what is attached to a number is a word of its own."""
    out = []
    for word in text.split():
        bare = dc._OUTER.sub("", word)
        low = bare.lower()
        if not low:
            continue
        ends, mark = word.rstrip("\"')]}»”’")[-1:] in list(".!?:"), not word[-1:].isalnum()
        attached = dc._ATTACHED.match(low)
        if attached and (attached[2] in dc.UNITS or attached[2] in ("am", "pm")):
            out += [("number", attached[1], False, False, False, False), ("unit" if attached[2] in dc.UNITS else None, attached[2], False, ends, mark, False)]
        elif dc._NUMBER.match(low):
            out.append(("number", low, False, ends, mark, False))
        elif all(p in dc.NUMBER_WORDS for p in low.split("-")):
            out.append(("number", low, False, ends, mark, True))
        elif low in dc.UNITS:
            out.append(("unit", low, False, ends, mark, False))
        else:
            out.append((None, low, bare[0].isupper() and not (len(bare) > 1 and bare.isupper()), ends, mark, False))
    return out


def template(text, named):
    """(placeholder or word, values) of a text; runs of a name's or number's words are one, up to four of them."""
    kinds, held = [], tokens(text)
    for k, (kind, value, capital, ends, mark, word) in enumerate(held):
        before = held[k - 1] if k else (None, "", False, True, False, False)
        if kind == "number":
            kinds.append(NUMBER)
        elif kind == "unit" and before[0] == "number":
            kinds.append(UNIT)
        elif capital and (named or not before[3]):
            kinds.append(NAME)
        else:
            kinds.append(None)
    runs = []
    for k, kind in enumerate(kinds):
        joins = k and kind and kind == kinds[k - 1] and not held[k - 1][4] and (kind == NAME or kind == NUMBER and held[k][5])
        if joins:
            runs[-1].append(k)
        else:
            runs.append([k])
    out = []
    for run in runs:
        for part in [run] if len(run) <= 4 else [[k] for k in run]:
            values = tuple(held[k][1] for k in part)
            out.append((kinds[part[0]] or values, values))
    return out


def windows(words, item, size=5, reach=15, least=3):
    """(start, whether by values, words) of the windows of an item or a document."""
    out, rich = [], set()
    is_literal = [isinstance(w[0], tuple) for w in words]
    for i in range(len(words)):
        ends = [e for e in range(i + size, min(len(words), i + reach) + 1) if sum(is_literal[i:e]) >= least]
        if ends:
            rich.add(i)
            out.append((i, False, words[i : ends[0]]))
        if i + size <= len(words) and sum(is_literal[i : i + size]) < least and not (item and ends):
            out.append((i, True, words[i : i + size]))
    if item and rich:
        def short_of(i):
            """Whether the item ends before the window at i has its literals."""
            third = [k for k in range(i, len(words)) if is_literal[k]][least - 1 : least]
            return not third
        out = [w for w in out if not w[1] or not short_of(w[0])]
    return out


def share(item, document, named):
    ours, theirs, best = windows(template(item, named), True), windows(template(document, named), False), {}
    for i, by_value, a in ours:
        for j, other, b in theirs:
            if by_value == other and len(a) == len(b) and [x[by_value] for x in a] == [y[by_value] for y in b]:
                best.setdefault(j - i, []).append((i, [(x[0], x[1], y[1]) for x, y in zip(a, b) if not isinstance(x[0], tuple)]))
    found = set()
    for held in best.values():
        slots = {}
        for _, s in held:
            for kind, mine, other in s:
                slots.setdefault((kind, mine), set()).add(other)
        if all(len(v) == 1 for v in slots.values()):
            found |= {i for i, _ in held}
    return len(found) / len(ours) if ours else 0.0


def leaks(documents, items):
    out = {}
    for d, text in documents.items():
        for k, item in items.items():
            if len(tokens(item)) >= 5 and (s := max(share(item, text, named) for named in (False, True))) >= 0.8:
                out[d, k] = s
    return out


def test_plain_words_are_read_like_any_others():
    rng = random.Random(12)
    stems = ["word", "Word", "WORD", "W", "w", "twelve", "Twelve", "km", "Km", "g", "twenty-five", "12kg", "3.5", "9am", "é", "Éa", "don't", "", "x7", "%", "Aé"]
    words = [rng.choice(["", "", "(", "\""]) + rng.choice(stems) + rng.choice(["", "", ".", ",", "?!", ".)", ":", ";", "\u201d"]) for _ in range(3000)]
    words = [w.encode() for w in words if w]
    got = dc._word_rows(words)
    for row, w in zip(got.tolist(), words):
        low, flags, rest, more = dc._word(w)
        assert row == [dc.xxhash.xxh64_intdigest(low, 1), flags, dc.xxhash.xxh64_intdigest(rest, 1) if rest else 0, more], w


FORMS = [
    "{a} has {n} red marbles in a bag. {b} gives {m} more marbles to {a} each week. How many marbles does {a} hold after {p} weeks?",
    "A train leaves {a} at {n} am and reaches {b} after {m} hours. How far is it from {a} to {b} if it drives {p} km in each hour of the trip?",
    "{a} sold {n} clips in the month of spring. {a} sold half as many clips in the next one. How many clips did {a} sell altogether in the year?",
    "Mix {n} kg flour, {m} kg sugar, {p} g salt and then {a} bakes it all for {b} in the big oven.",
    "The shop of {b} asks {n} dollars for a box that weighs {m} kg while {a} pays {p} dollars for the same box and then sells it on.",
]
NAMES = ["Alice", "Bob", "Dora", "New York", "Boston", "Carol Ann Smith", "Erik", "Natalia", "Kevin"]


def filled(rng, form):
    """A form with other names and numbers, each value in one slot only, as one that stood for two would tell them apart."""
    a, b = rng.sample(NAMES, 2)
    n, m, p = rng.sample([*map(str, range(2, 99)), *["twelve", "twenty five", "seven", "3.5"] * 20], 3)
    while len({n, m, p}) < 3:
        n, m, p = rng.sample(["14", "twelve", "twenty five", "seven", "3.5", "88"], 3)
    return form.format(a=a, b=b, n=n, m=m, p=p)


def test_generated_questions_equal_brute_force(spark, docs):
    rng = random.Random(8)
    items = {k: filled(rng, form) for k, form in enumerate(FORMS)}
    documents, meant = {}, set()
    for d in range(60):
        form = d % len(FORMS)
        text = filled(rng, FORMS[form])
        if d % 5 == 4:  # a slot that changes inside the question, or words that do: chance likeness
            words = text.split()
            for _ in range(8):
                words[rng.randrange(len(words))] = rng.choice(["purple", "Zed", "88"])
            text = " ".join(words)
        else:
            meant.add((d, form))
        documents[d] = rng.choice(["", "Words before it. ", "And then said nobody at all "]) + text + rng.choice(["", " Words behind."])
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in dc.leaks(docs(list(documents.items())), bench).collect()}
    want = leaks(documents, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert meant <= got.keys()


def test_all_names_and_numbers_changed(spark, docs):
    item = "Alice has 12 apples and 3 pears. Bob gives her 4 more apples. Carol takes 2 of the pears away. How many pieces of fruit does Alice have now?"
    other = item
    for a, b in (("Alice", "Dora"), ("Bob", "Erik"), ("Carol", "Fay"), ("12", "31"), ("3 ", "8 "), ("4", "9"), (" 2 ", " 5 ")):
        other = other.replace(a, b)
    mixed = re.sub("does Dora", "does Erik", other)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["identical"] for r in dc.leaks(docs([(1, other), (2, item), (3, "Nobody has apples or pears here.")]), bench).collect()}
    assert got == {1: False, 2: True}
    assert set(leaks({1: other, 2: mixed}, {1: item})) == {(r["doc_id"], 1) for r in dc.leaks(docs([(1, other), (2, mixed)]), bench).collect()}
