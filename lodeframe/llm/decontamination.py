"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a benchmark question and the same
question with other values have one template.  Windows of template words are hash-joined with the
benchmark's windows; the values that stand in the placeholders must then map consistently from the
question to the document, which tells a re-parameterised question from chance.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Vocabulary, checkpoint, drop_stored, id_or_null, keyed, mix64, slices, spare_names, stored
from .grams import flat_words

#: Units of measure and money that may follow a number.
UNITS = frozenset("% ° $ € £ mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs day days week weeks month months year years hour hours minute minutes second seconds mph kph km/h m/s j kj w kw kwh v a hz khz mhz ghz kb mb gb tb usd eur gbp dollar dollars euro euros pound pounds cent cents meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram kilograms liter liters litre litres degree degrees percent".split())
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?$")
#: A number with what is attached to it, and what may be attached besides units.
_ATTACHED, _ALSO = re.compile(r"([-+]?[$€£]?\d[\d.,:/]*)([^\d.,:/].*)$"), frozenset(("am", "pm"))
_OUTER = re.compile(r"^[^\w%°$€£+-]+|[^\w%°$€£]+$")
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
_IS_NUMBER, _IS_UNIT, _IS_CAPITAL, _ENDS, _BLANK, _IS_NUMBER_WORD, _MARK = 1, 2, 4, 8, 16, 32, 64
#: Number words and units with their flags.
_SPECIAL = {w: _IS_UNIT for w in UNITS} | {w: _IS_NUMBER | _IS_NUMBER_WORD for w in NUMBER_WORDS}
#: Words that one name or number may have; longer runs of capitals are titles, whose words stand for themselves.
MOST_WORDS = 4
#: How many times its nominal length a window may reach for literal words, and how many it should hold.
REACH, LEAST_LITERALS = 3, 3
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
#: Ways to read a text: capitals that open a sentence as literals, the same as names, and words as they are.
PLAIN, NAMED, WHOLE = 0, 1, 2


def _word(raw: bytes) -> tuple[bytes, int, bytes, int]:
    """(bare lower-cased word or its number, flags, what is attached to the number, its flags) of any word."""
    word = raw.decode()
    bare = _OUTER.sub("", word)
    low = bare.lower()
    flags = _ENDS if word.rstrip("\"')]}»”’")[-1:] in tuple(".!?:") else 0
    flags |= 0 if word[-1:].isalnum() else _MARK
    attached = _ATTACHED.match(low)
    if not low:
        flags |= _BLANK
    elif attached and (attached[2] in UNITS or attached[2] in _ALSO):
        return attached[1].encode(), _IS_NUMBER, attached[2].encode(), flags | (_IS_UNIT if attached[2] in UNITS else 0)
    elif _NUMBER.match(low):
        flags |= _IS_NUMBER
    elif all(part in NUMBER_WORDS for part in low.split("-")):
        flags |= _IS_NUMBER | _IS_NUMBER_WORD
    elif low in UNITS:
        flags |= _IS_UNIT
    elif bare[0].isupper() and not (len(bare) > 1 and bare.isupper()):
        flags |= _IS_CAPITAL
    return low.encode(), flags, b"", 0


def _word_rows(words: list[bytes]) -> np.ndarray:
    """(hash of the bare lower-cased word or of its number, flags, hash and flags of what is attached to the number) of every word.

    Most words are letters with a mark behind them at most; they need none of the patterns.
    """
    hashes, kinds, others = [], [], []
    digest, capital = xxhash.xxh64_intdigest, _IS_CAPITAL
    for k, raw in enumerate(words):
        word = raw.decode()
        core = word.rstrip(".,;:!?")
        if not core.isalpha():
            low, flags, rest, more = _word(raw)
            if rest:
                others.append((k, digest(rest, 1), more))
            hashes.append(digest(low, 1))
            kinds.append(flags)
            continue
        low, flags = core.lower(), 0
        if core is not word and len(core) < len(word):
            flags = _MARK | (_ENDS if word[-1] in ".!?:" else 0)
        if low in _SPECIAL:
            flags |= _SPECIAL[low]
        elif low != core and core[0].isupper() and (len(core) == 1 or not core.isupper()):
            flags |= capital
        hashes.append(digest(low.encode(), 1))
        kinds.append(flags)
    out = np.zeros((len(words), 4), np.uint64)
    out[:, 0], out[:, 1] = np.array(hashes, np.uint64), np.array(kinds, np.uint64)
    for k, rest, more in others:
        out[k, 2:] = rest, more
    return out


def _tokens(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Literal hashes, flags and texts of all words that are not blank; what is attached to a number is a word of its own."""
    text = np.repeat(np.arange(len(counts)), counts)
    full = (words[:, 1] & np.uint64(_BLANK)) == 0
    words, text = words[full], text[full]
    parts = 1 + (words[:, 2] > 0)
    first = np.cumsum(parts) - parts
    literal, flags = np.repeat(words[:, 0], parts), np.repeat(words[:, 1], parts)
    two = np.flatnonzero(parts == 2)
    literal[first[two] + 1], flags[first[two] + 1] = words[two, 2], words[two, 3]
    return literal, flags.astype(np.int64), np.repeat(text, parts)


def _templates(literal: np.ndarray, flags: np.ndarray, text: np.ndarray, n: int, view: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, literal hashes and kinds of the words of ``n`` texts, and how many each text has.

    A capital opens a name; where it stands first in its text or after a mark that ends a sentence or a line's label it
    does so in the view NAMED only.  A name or number of several words is one; in the view WHOLE all words are literals.
    """
    if view == WHOLE:
        return mix64(literal), literal, np.zeros(len(literal), np.int64), np.bincount(text, minlength=n)
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    before = np.zeros(len(text), np.int64)
    before[1:] = flags[:-1]
    before[first] = _ENDS
    name = ((flags & _IS_CAPITAL) > 0) & (((before & _ENDS) == 0) | (view == NAMED))
    kind = np.where(flags & _IS_NUMBER, NUMBER, np.where((flags & _IS_UNIT) & ((before & _IS_NUMBER) * 2), UNIT, np.where(name, NAME, LITERAL)))
    same = np.zeros(len(text), bool)
    same[1:] = (kind[1:] == kind[:-1]) & ~first[1:] & ((before[1:] & _MARK) == 0) & ((kind[1:] == NAME) | ((flags[1:] & _IS_NUMBER_WORD) > 0))
    start = np.flatnonzero(~same)
    size = np.diff(np.append(start, len(text)))
    apart = np.repeat(size > MOST_WORDS, size)
    start = np.flatnonzero(~same | apart)
    size = np.diff(np.append(start, len(text)))
    value = literal[start]
    for k in range(1, MOST_WORDS):
        more = size > k
        value[more] = mix64(value[more] * np.uint64(0x9E3779B97F4A7C15) + literal[start[more] + k])
    kind, text = kind[start], text[start]
    template = np.where(kind == LITERAL, value, kind.astype(np.uint64))
    return mix64(template), value, kind, np.bincount(text, minlength=n)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of _ODD and of its inverse, grown as they are needed


def _run_sums(values: np.ndarray) -> np.ndarray:
    """Sums of all values before each place, weighed by place; ``_run_hashes`` takes runs out of them."""
    if len(_powers[0]) < len(values):
        for k, base in enumerate((_ODD, _INVERSE)):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * len(values), base, np.uint64))])
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers[0][: len(values)])])


def _run_hashes(sums: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    """A hash for each run of scrambled values, the same wherever the run stands."""
    return mix64((sums[start + size] - sums[start]) * _powers[1][start] + (size.astype(np.uint64) << np.uint64(8)) + np.uint64(salt))


def _windows(template: np.ndarray, literal: np.ndarray, kind: np.ndarray, counts: np.ndarray, size: int, least: int, item: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and hashes of windows inside one text.

    A window of few literal words would fit almost any list of values, so each reaches from its start over ``size`` words and on
    until it holds ``least`` literal ones, over ``REACH`` times ``size`` words at most.  Where that many do not come, ``size`` words are
    hashed with their values; a document has such a window at every start with too few literals, as the item may end where it goes on.
    """
    n, ends = len(template), np.cumsum(counts)
    end = np.repeat(ends, counts)
    start = np.arange(n)
    inside = start + size <= end
    if not least:
        start = start[inside]
        return start, np.full(len(start), size), _run_hashes(_run_sums(template), start, np.full(len(start), size), 1)
    is_literal = kind == LITERAL
    places = np.flatnonzero(is_literal)
    enough = np.cumsum(is_literal) - is_literal + least - 1  # the place that completes the literal words of a window
    reach = np.where(enough < len(places), np.concatenate([places, [0]])[np.minimum(enough, len(places))] + 1, n + 1)
    until = np.maximum(reach, start + size)
    rich = (until <= end) & (until - start <= REACH * size)
    poor = inside & (reach > start + size)
    if item:
        # The last words of an item that has better windows need none of their own.
        better = np.bincount(np.repeat(np.arange(len(counts)), counts), rich, minlength=len(counts)) > 0
        poor &= ~rich & ~(np.repeat(better, counts) & (until > end))
    a, b = start[rich], start[poor]
    lengths = np.concatenate([until[rich] - a, np.full(len(b), size)])
    hashes = np.concatenate([_run_hashes(_run_sums(template), a, lengths[: len(a)], 1), _run_hashes(_run_sums(literal), b, lengths[len(a) :], 2)])
    return np.concatenate([a, b]), lengths, hashes


class Sieve:
    """Tells which window hashes the benchmark may have: all of them exactly, or by two bits of a field of fixed size, which lets a few others pass."""

    def __init__(self, exact: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.exact, self.bits = exact, bits
        if exact is not None:
            self.first = np.zeros(1 << 22, bool)
            self.first[(exact & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        if self.exact is not None:
            hit = np.flatnonzero(self.first[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            return hit[np.isin(h[hit], self.exact)]
        last = np.uint64(len(self.bits) * 64 - 1)
        held = np.ones(len(h), bool)
        for at in (h & last, (h >> np.uint64(32)) & last):
            held &= ((self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return np.flatnonzero(held)


def _collected(numbers: DataFrame) -> np.ndarray:
    """A table of 64-bit numbers as a matrix on the driver, sent as bytes."""

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.to_numpy() for c in batch.columns], 1).tobytes()], pa.binary())], names=["b"])

    found = b"".join(r["b"] for r in numbers.mapInArrow(pack, "b binary").collect())
    return np.frombuffer(found, np.int64).reshape(-1, len(numbers.columns)).view(np.uint64)


def sieve_of(hashes: DataFrame, most: int, bits: int = 26) -> Sieve:
    """hashes(hash): up to ``most`` distinct ones are held as they are, more by a field of 2^bits bits that tasks fill together."""
    distinct = hashes.distinct()
    if distinct.limit(most + 1).count() <= most:
        return Sieve(np.sort(_collected(distinct)[:, 0]))
    last = F.lit((1 << bits) - 1).cast("long")
    place = F.explode(F.array(F.col("hash").bitwiseAND(last), F.shiftrightunsigned("hash", 32).bitwiseAND(last)))
    words = distinct.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    field = np.zeros(1 << (bits - 6), np.uint64)
    found = _collected(words)
    field[found[:, 0].astype(np.int64)] = found[:, 1]
    return Sieve(bits=field)


def template_windows(texts: DataFrame, size: int, only: Sieve | None = None, wholes: list[int] | None = None) -> DataFrame:
    """texts(doc_id, text, row) -> (doc_id, row, view, size, pos, hash, kinds array<int>, literals array<long>, n_windows) for every window of ``size`` words or more.

    n_windows counts the windows of the text in the view.  With ``only``, windows that it does not pass are not emitted.  The
    view WHOLE has windows of the sizes ``wholes``; without them, those of whole texts that are too short for ``size``.
    """

    def run(batches):
        vocabulary = Vocabulary(_word_rows)
        for batch in batches:
            whole = batch.column(1).cast(pa.binary()).to_pylist()
            for i, j in slices(np.fromiter(map(len, whole), np.int64, len(whole)), 1_500_000):
                words, counts = flat_words(whole[i:j])
                ids = vocabulary.ids(words)
                if not len(ids):
                    continue
                tokens, n = _tokens(vocabulary.table[ids], counts), len(counts)
                short = np.bincount(tokens[2], minlength=n)
                passes = [(view, size) for view in (PLAIN, NAMED)] + [(WHOLE, s) for s in (wholes if wholes is not None else [0])]
                for view, width in passes:
                    template, literal, kind, counts = _templates(*tokens, n, view)
                    if view == PLAIN:
                        short[counts >= size] = 0
                    text, begin = np.repeat(np.arange(n), counts), np.cumsum(counts) - counts
                    if view == WHOLE and wholes is None:
                        # Texts of one length at a time.
                        portions = []
                        for width in np.unique(short[short > 0]).tolist():
                            at, long, h = _windows(template, literal, kind, counts, width, 0, True)
                            own = short[text[at]] == width
                            portions.append((width, at[own], long[own], _whole(h[own])))
                    else:
                        at, long, h = _windows(template, literal, kind, counts, width, min(LEAST_LITERALS, width) if view != WHOLE else 0, wholes is None)
                        portions = [(width, at, long, _whole(h) if view == WHOLE else h + np.uint64(view))]
                    for width, at, long, h in portions:
                        total = np.bincount(text[at], minlength=n)
                        if only is not None:
                            hit = only.places(h)
                            at, long, h = at[hit], long[hit], h[hit]
                        if view == WHOLE:  # one place of each in a text will do
                            one = np.sort(np.unique(np.stack([text[at].astype(np.uint64), h]), axis=1, return_index=True)[1])
                            at, long, h = at[one], long[one], h[one]
                        # Without a sieve every window goes out; in portions, as each carries its words.
                        for k in range(0, len(at), 50_000):
                            part, size_of = at[k : k + 50_000], long[k : k + 50_000]
                            offsets = np.concatenate([[0], np.cumsum(size_of)])
                            cover = np.repeat(part - offsets[:-1], size_of) + np.arange(offsets[-1])
                            offsets = pa.array(offsets.astype(np.int32))
                            yield pa.RecordBatch.from_arrays(
                                [
                                    *[batch.column(c).slice(i, j - i).take(pa.array(text[part])) for c in (0, 2)],
                                    pa.array(np.full(len(part), view, np.int32)),
                                    pa.array(np.full(len(part), width, np.int32)),
                                    pa.array((part - begin[text[part]]).astype(np.int32)),
                                    pa.array(h[k : k + 50_000].view(np.int64)),
                                    pa.ListArray.from_arrays(offsets, pa.array(kind[cover].astype(np.int32))),
                                    pa.ListArray.from_arrays(offsets, pa.array(literal[cover].view(np.int64))),
                                    pa.array(total[text[part]].astype(np.int32)),
                                ],
                                names=["doc_id", "row", "view", "size", "pos", "hash", "kinds", "literals", "n_windows"],
                            )

    return texts.mapInArrow(run, "doc_id long, row long, view int, size int, pos int, hash long, kinds array<int>, literals array<long>, n_windows int")


def _whole(h: np.ndarray) -> np.ndarray:
    """Hashes of whole short texts, apart from those of templates."""
    return mix64(h + np.uint64(WHOLE))


def _rows(texts: DataFrame) -> DataFrame:
    """(doc_id, text, row); row, a hash of id and text, tells different texts of one id apart."""
    return keyed(texts).withColumn("row", F.xxhash64("doc_id", "text"))


def leaks(documents: DataFrame, benchmark: DataFrame, window: int = 5, least_share: float = 0.8, sieve_limit: int = 2_000_000) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> (doc_id, item_id, share, identical) for every leaked item.

    share is the share of an item's template windows that the document holds in consistent alignments; an item leaks at
    ``least_share`` or more.  An alignment is a fixed distance between the places in document and item; it is consistent
    if every value of the item stands for one value in the document.  identical: all values are the item's own.
    Sentences' first capitals are read as literals and as names; the better reading counts.  An item of fewer than ``window``
    words, names and numbers counted as one each, must stand in the document word for word.  A null text is empty; null ids
    are kept as null.  Every row is judged by itself, also where ids repeat or are null; of the rows of a pair of ids the best
    counts, so ties and repeated rows give one row per pair.  Further columns are ignored.

    The benchmark's window hashes, up to ``sieve_limit`` of them as they are and more as a bit field of fixed size, are sent along to drop other
    windows where they arise.  An item that leaks has a match among any windows that are more than it may miss, so documents
    and items are paired by that many of each item's rarest windows only; all windows are compared for those pairs.
    """
    known = template_windows(_rows(benchmark.select(F.col("item_id").alias("doc_id"), "text")).distinct(), window)
    known = checkpoint(known.select(F.col("doc_id").alias("item"), F.col("row").alias("item_row"), "view", "size", F.col("pos").alias("item_pos"), "hash", F.col("literals").alias("item_literals"), F.col("n_windows").alias("of")))
    wholes = sorted(r[0] for r in known.where(F.col("view") == WHOLE).select("size").distinct().collect())
    same, item, document = ["hash", "view", "size"], ["item", "item_row"], ["doc_id", "row"]
    found = stored(template_windows(_rows(documents), window, sieve_of(known.select("hash"), sieve_limit), wholes).drop("n_windows"))
    met = found.groupBy(*same).agg(F.count("*").alias("met"))
    missable = F.floor(F.col("of") * (1 - least_share) + 1e-9)
    rare = known.join(met, same, "left").withColumn("place", F.row_number().over(Window.partitionBy(*item, "view").orderBy(F.coalesce("met", F.lit(0)), "item_pos", "hash")))
    rare = rare.where(F.col("met").isNotNull() & (F.col("place") <= missable + 1)).select(*same, *item).distinct()
    pairs = checkpoint(found.select(*document, *same).join(rare, same).select(*document, *item, "view").distinct())
    hits = pairs.join(known, [*item, "view"]).join(found, [*document, *same])
    slots = F.filter(F.arrays_zip("kinds", "item_literals", "literals"), lambda s: s["kinds"] != LITERAL)
    hits = checkpoint(hits.select(*document, *item, "view", "of", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), slots.alias("slots")))  # read three times below
    drop_stored(found)
    line = [*document, *item, "view", "shift"]
    slots = hits.select(*line, F.explode("slots").alias("s")).select(*line, F.struct("s.kinds", "s.item_literals").alias("a"), F.col("s.literals").alias("b")).distinct()
    clash = slots.groupBy(*line, "a").agg(F.count("*").alias("n")).where("n > 1").select(*line).distinct()
    changed = slots.groupBy(*line).agg(F.bool_or(F.col("a.item_literals") != F.col("b")).alias("changed"))
    kept = hits.join(clash, line, "left_anti").join(changed, line, "left")
    pairs = kept.groupBy(*document, *item, "view").agg(
        (F.count_distinct("item_pos") / F.max("of")).alias("share"),
        (F.count_distinct(F.when(~F.coalesce("changed", F.lit(False)), F.col("item_pos"))) / F.max("of")).alias("as_is"),
    )
    pairs = pairs.groupBy("doc_id", "item").agg(F.max("share").alias("share"), F.max("as_is").alias("as_is"))
    pairs = pairs.where(F.col("share") >= least_share)
    return pairs.select(id_or_null("doc_id").alias("doc_id"), id_or_null("item").alias("item_id"), "share", (F.col("as_is") >= least_share).alias("identical"))


def without_leaks(documents: DataFrame, benchmark: DataFrame, window: int = 5, least_share: float = 0.8) -> DataFrame:
    """The documents in which no benchmark item leaks, with all their columns.

    A null or empty text holds no item and is kept; rows equal in id and text stay or go together; a null id is kept as null.  An
    empty table gives an empty result, an empty benchmark keeps all rows; further columns are kept, whatever their names.
    """
    own, hit = spare_names(documents, "__key", "__hit")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    hits = leaks(documents.select(key.alias("doc_id"), "text"), benchmark, window, least_share).select(F.col("doc_id").alias(hit)).distinct()
    return documents.withColumn(own, key).join(hits, F.col(own) == F.col(hit), "left_anti").select(*documents.columns)
