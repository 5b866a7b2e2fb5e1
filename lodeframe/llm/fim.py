"""Fill-in-middle transformation on ropes.

A text is held as a rope: a binary tree whose leaves are pieces of text and whose nodes cache how many units (line ends) and code
points lie below them.  Cutting a document is two splits of its tree at unit ranks, rearranging it is a few concatenations
with sentinels between, and undoing it splits the tree of the output at the code points where the sentinels stand.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Code points of a leaf.
LEAF = 4096
#: What a split counts by; also the places of the counts in a tree.
UNITS, POINTS = 0, 1

#: (line ends, code points, text) for a leaf, (line ends, code points, left, right) for a node.
Rope = tuple


def leaf(text: str) -> Rope:
    return text.count("\n"), len(text), text


def concat(a: Rope, b: Rope) -> Rope:
    """The two texts after each other; small leaves become one, an empty side falls away."""
    if not a[POINTS] or not b[POINTS]:
        return a if a[POINTS] else b
    if len(a) == len(b) == 3 and a[POINTS] + b[POINTS] <= LEAF:
        return a[UNITS] + b[UNITS], a[POINTS] + b[POINTS], a[2] + b[2]
    return a[UNITS] + b[UNITS], a[POINTS] + b[POINTS], a, b


def rope(text: str) -> Rope:
    """A balanced tree over leaves of ``LEAF`` code points."""
    level = [leaf(text[k : k + LEAF]) for k in range(0, len(text), LEAF)] or [leaf("")]
    while len(level) > 1:
        level = [reduce(concat, level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0]


def split(tree: Rope, rank: int, by: int) -> tuple[Rope, Rope]:
    """The tree up to ``rank`` units or code points, and the rest; a rank above all there are leaves the rest empty.

    Units end with a line end, so the cut lies right behind the line end of that rank.
    """
    if rank > tree[by]:
        return tree, leaf("")
    if len(tree) == 3:
        at = rank
        if by == UNITS:
            at = 0
            for _ in range(rank):
                at = tree[2].index("\n", at) + 1
        return leaf(tree[2][:at]), leaf(tree[2][at:])
    left, right = tree[2], tree[3]
    if rank <= left[by]:
        a, b = split(left, rank, by)
        return a, concat(b, right)
    a, b = split(right, rank - left[by], by)
    return concat(left, a), b


def text_of(tree: Rope) -> str:
    parts, open_ = [], [tree]
    while open_:
        node = open_.pop()
        if len(node) == 3:
            parts.append(node[2])
        else:
            open_ += [node[3], node[2]]
    return "".join(parts)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers from the sha256 of ``seed:doc_id``, its first four groups of eight hex digits (no id: nothing after the colon)."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]


def rearranged(text: str, doc_id: int | None, seed: int, fim_percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    tree = rope(text)
    n = tree[UNITS] + (not text.endswith("\n") and text != "")
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(s in text for s in sentinels) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split(tree, last, UNITS)
    prefix, middle = split(head, first, UNITS)
    p, s, m = map(leaf, sentinels)
    spm = h4 % 100 < spm_percent
    order = [s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle]
    return n, "spm" if spm else "psm", prefix[POINTS], middle[POINTS], text_of(reduce(concat, order))


def undone(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that gave ``output``: its tree is split at the sentinels and the parts are put back in order."""
    if form == "plain":
        return output
    p, s, m = sentinels
    first, second = (s, p) if form == "spm" else (p, s)
    # From the last one on, so that a split leaves the places before it as they are.
    head, middle = split(rope(output), output.index(m), POINTS)
    head, b = split(head, output.index(second), POINTS)
    parts = [split(part, len(mark), POINTS)[1] for part, mark in ((head, first), (b, second), (middle, m))]
    prefix, suffix = (parts[1], parts[0]) if form == "spm" else (parts[0], parts[1])
    return text_of(concat(concat(prefix, parts[2]), suffix))


def fill_in_middle(documents: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, batch_chars: int = 8_000_000) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n, form, prefix_chars, middle_chars, output), a row for every row.

    A text of n lines is cut behind two line ranks, which come from a hash of seed and id, into prefix, middle and suffix.  ``form`` is psm
    (prefix, suffix, middle), spm (suffix, prefix, middle) or plain: an empty or null text, one that holds a sentinel, or one whose draw is not
    below ``fim_percent``.  prefix_chars and middle_chars are code points, null for plain.  Equal rows give equal rows; a null id is drawn
    for as an empty one; the last line need not end; one endless line is one unit.  An empty table gives an empty result; further
    columns are ignored.  A text is worked on alone, so nothing is shuffled and a lost task repeats itself exactly.

    Sentinels are of (prefix, suffix, middle).  None may begin with what another or itself ends with, so that none can arise between a text and a sentinel.
    """
    marks = tuple(sentinels)
    overlap = (a.endswith(b[:k]) for a in marks for b in marks for k in range(1, len(b) + (a != b)))
    if len(set(marks)) < 3 or "" in marks or any(overlap) or any(b in a for a in marks for b in marks if a != b):
        raise ValueError("sentinels must be different, and none may overlap another")

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.append((doc, *rearranged(text.as_py(), doc, seed, fim_percent, spm_percent, marks)))
                held += len(rows[-1][-1])
                if held >= batch_chars:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from; null where output or form is null."""
    marks = tuple(sentinels)

    @F.arrow_udf("string")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        both = zip(outputs, forms.to_pylist())
        return pa.array([None if f is None or not o.is_valid else undone(o.as_py(), f, marks) for o, f in both], pa.string())

    return back(output, form)
