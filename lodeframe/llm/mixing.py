"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame operations only.

Every source's documents are dealt to shards and laid end to end in seeded order; each shard's line
of tokens is cut into blocks of equal size.  Blocks are apportioned to (source, shard) pairs by the
highest quotients target / (2 s + 1), which gives integer quotas.  A shard takes all of its blocks
``quota div blocks`` times and ``quota mod blocks`` of them once more, picked by a systematic draw
with a seeded start.  The picks before any token of the line have a closed form, so what a document
gives is a difference of two such sums and no row per block is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.text import with_row_id
from .common import WORD, checkpoint, small, spare_names


def token_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _water_level(sources: DataFrame, total: float, held: int) -> float:
    """Level L at which the sum of least(most, weight * L) over sources(most, weight, full_at) is ``total``; infinite if all are full before.

    Sources are full in order of full_at = most / weight.  At most ``held`` of those levels reach the driver: of a longer list
    the sums between approximate percentiles tell the stretch that holds L, and the search goes on in it.
    """
    rows = sources.where("weight > 0 and most > 0").groupBy("full_at").agg(F.sum("most").alias("most"), F.sum("weight").alias("weight"))
    full, open_weight = 0.0, rows.agg(F.sum("weight")).first()[0] or 0.0
    while True:
        n = rows.limit(held + 1).count()
        if n <= held:
            stretches = sorted((r["full_at"], r["most"], r["weight"]) for r in rows.collect())
        else:
            cuts = rows.agg(F.percentile_approx("full_at", [k / 256 for k in range(1, 256)], 10_000)).first()[0]
            no = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("full_at")))
            sums = rows.groupBy(no.alias("no")).agg(F.max("full_at").alias("full_at"), F.min("full_at").alias("least"), F.sum("most").alias("most"), F.sum("weight").alias("weight"))
            stretches = sorted((r["full_at"], r["most"], r["weight"], r["least"]) for r in sums.collect())
        for stretch in stretches:
            end, most, weight = stretch[:3]
            # Were all up to this end full, the others would stand at a level of at least the end.
            rest = open_weight - weight
            if n <= held:
                if (total - full) / open_weight <= end:
                    return (total - full) / open_weight
            elif full + most + rest * end >= total:
                rows = rows.where((F.col("full_at") >= stretch[3]) & (F.col("full_at") <= end))
                break
            full, open_weight = full + most, rest
            if open_weight <= 1e-9 * weight:
                return float("inf")
        else:
            return (total - full) / open_weight if open_weight > 0 else float("inf")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, ceiling: float, held: int = 100_000) -> DataFrame:
    """sizes(source, source_size) -> (source, source_size, source_no, target).

    Sources take the weights in turn, in code point order with null last.  ``share`` times all sizes
    is dealt by weight; what would exceed ``ceiling`` times a source's size is dealt again by weight, which comes to one level
    per unit of weight for all sources that are not full.  Sources are numbered and levels found without gathering them anywhere.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = with_row_id(sizes.withColumn("__none", F.col("source").isNull()), ["__none", "source"], "source_no").drop("__none")
    ranked = ranked.withColumn("source_no", F.col("source_no") + 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(ceiling))).withColumn("full_at", F.col("most") / F.col("weight"))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    target = F.least("most", F.col("weight") * F.lit(_water_level(ranked, total, held)))
    return ranked.select("source", "source_size", "source_no", target.alias("target"))


def sainte_lague(parties: DataFrame, seats: int) -> DataFrame:
    """parties(party long, votes double) -> (party, quota long): ``seats`` seats by the highest quotients votes / (2 s + 1).

    A divisor a little too large gives most seats at once, as every quotient above it wins; only the few
    quotients between it and a divisor a little too small are ranked, so rows stay in proportion to parties, and they are ranked
    in ranges of quotients, not in one task.  Equal quotients go to the smaller party.
    """
    parties = parties.where("votes > 0")
    n, total = parties.agg(F.count("*"), F.sum("votes")).first()
    if not n or seats <= 0:
        return parties.select("party", F.lit(0).cast("long").alias("quota"))
    sure = F.floor(F.col("votes") * F.lit(max(seats - n, 0) / total) + 0.5)
    most = F.floor(F.col("votes") * F.lit((seats + n) / total) + 0.5) + 1
    known = parties.select("party", "votes", sure.cast("long").alias("sure"), most.cast("long").alias("most"))
    left = seats - known.agg(F.sum("sure")).first()[0]
    open_seats = known.withColumn("seat", F.explode(F.sequence("sure", "most"))).select("party", (-F.col("votes") / (2 * F.col("seat") + 1)).alias("behind"))
    won = with_row_id(open_seats, ["behind", "party"], "place").where(F.col("place") < left)
    extra = won.groupBy("party").agg(F.count("*").alias("extra"))
    return known.join(extra, "party", "left").select("party", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("quota"))


def mix(
    documents: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    ceiling: float = 2.0,
    block_tokens: int = 64,
    shard_docs: int = 8192,
    seed: int = 7,
) -> DataFrame:
    """documents(doc_id, text, source) -> (doc_id, source, size, source_size, target, taken, first_token, shard, quota, blocks).

    taken counts words, repeats included, and is at most ceil(ceiling) times size.  A null source is a source of
    its own; a null or empty text has size 0 and gives nothing; documents with equal ids are laid by their text's
    hash, so reruns agree; an empty table gives an empty result; further columns are ignored.
    A source's documents are numbered in the order of a hash of id and text, and each ``shard_docs`` of them are a shard, so neither a
    hot source nor a row that is repeated many times is laid out in one task.
    """
    spread = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    docs = checkpoint(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), token_count(F.col("text")).alias("size"), spread.alias("spread")))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = small(source_targets(sizes.select("source", "source_size"), weights, share, ceiling))

    docs = docs.join(targets, docs.source.eqNullSafe(targets.source)).select(docs["*"], "source_no", "source_size", "target")
    docs = with_row_id(docs, ["source_no", "spread", "doc_id", "size"], "at")
    firsts = small(docs.groupBy("source_no").agg(F.min("at").alias("first_at")))
    docs = docs.join(firsts, "source_no").withColumn("shard", F.expr(f"(at - first_at) div {shard_docs}"))
    line = Window.partitionBy("source_no", "shard").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = docs.groupBy("source_no", "shard").agg(F.sum("size").alias("line"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    lines = lines.withColumn("party", F.col("source_no") * F.lit(2**31) + F.col("shard")).withColumn("votes", F.try_divide(F.col("target") * F.col("line"), F.col("source_size")))
    lines = checkpoint(lines.withColumn("blocks", F.ceil(F.col("line") / block_tokens)))
    goal = lines.agg(F.sum("votes")).first()[0] or 0.0
    quotas = sainte_lague(lines.select("party", "votes"), round(goal / block_tokens))
    # At most the ceiling: a partly filled last block may let a quota round above it.
    lines = lines.join(quotas, "party", "left").select("source_no", "shard", "blocks", F.least(F.coalesce("quota", F.lit(0)), F.floor(F.col("blocks") * ceiling).cast("long")).alias("quota"))
    docs = docs.withColumn("first_token", F.coalesce(F.sum("size").over(line), F.lit(0)))
    docs = docs.join(lines, ["source_no", "shard"])

    start = F.pmod(F.xxhash64(F.lit(seed), "source_no", "shard"), F.greatest("blocks", F.lit(1)))
    rounds, rest = F.expr("quota div greatest(blocks, 1)"), F.expr("quota % greatest(blocks, 1)")
    docs = docs.withColumn("start", start).withColumn("rounds", rounds).withColumn("rest", rest)

    def picked(block: str) -> str:
        return f"(({block}) * rest + start) div greatest(blocks, 1)"

    def taken_before(token: str) -> Column:
        block = f"(({token}) div {block_tokens})"
        return F.expr(f"{picked(block)} * {block_tokens} + (({token}) % {block_tokens}) * ({picked(block + ' + 1')} - {picked(block)})")

    extra = taken_before("first_token + size") - taken_before("first_token")
    taken = F.col("rounds") * F.col("size") + extra
    return docs.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "first_token", "shard", "quota", "blocks", "rounds", "rest", "start", "spread")


def mixed_documents(documents: DataFrame, block_tokens: int = 512, **options) -> DataFrame:
    """The rows of the mix, with the columns of ``documents``: a document as often as it is taken whole, and once more in part.

    The part holds the words of the blocks that are taken once more, joined by blanks; all words of a document make the document
    itself.  n_chars, where there is such a column, is the new text's length.  A document that gives nothing is left out, as are
    null and empty texts, which have no words.  Rows equal in id and text are told apart by their place among each other.  A null id or
    source is kept; an empty table gives an empty result; any further columns are kept, whatever their names.
    """
    seed = options.get("seed", 7)
    own_id, spread, copy, whole, words = spare_names(documents, "__id", "__spread", "__copy", "__whole", "__words")
    drawn_names = dict(zip(("size", "taken", "first_token", "rounds", "rest", "start", "blocks"), spare_names(documents, *(f"__{c}" for c in ("size", "taken", "first_token", "rounds", "rest", "start", "blocks")))))
    size, taken, first, rounds, rest, start, blocks = drawn_names.values()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    hashed = F.xxhash64(F.lit(seed), key, F.coalesce(F.col("text"), F.lit("")))
    own = [own_id, spread]
    rows = documents.withColumns({own_id: key, spread: hashed})
    drawn = mix(documents, block_tokens=block_tokens, **options)
    drawn = drawn.select(key.alias(own_id), F.col("spread").alias(spread), F.col("source").alias(whole), *[F.col(c).alias(n) for c, n in drawn_names.items()])
    repeated = checkpoint(rows.groupBy(*own).agg(F.count("*").alias(size)).where(F.col(size) > 1).select(*own))
    if repeated.limit(1).count():
        repeated = small(repeated)

        def numbered(df: DataFrame, order: list[str]) -> DataFrame:
            """Rows of repeated documents numbered in each by an order, those of others 0."""
            several = with_row_id(df.join(repeated, own, "left_semi"), [*own, *order], copy)
            firsts = several.groupBy(*own).agg(F.min(copy).alias("first_copy"))
            several = several.join(small(firsts), own).withColumn(copy, F.col(copy) - F.col("first_copy")).drop("first_copy")
            return df.join(repeated, own, "left_anti").withColumn(copy, F.lit(0).cast("long")).unionByName(several)

        # Copies of a document are numbered by source, in the table and in the mix alike.
        rows, drawn, own = numbered(rows, ["source"]), numbered(drawn, [whole, first]), [*own, copy]
    rows = rows.join(drawn.drop(whole).where(f"{taken} > 0"), own)
    part = F.expr(f"{taken} - {rounds} * {size}")
    times = F.col(rounds) + F.when(part == F.col(size), 1).otherwise(0)
    kinds = F.concat(F.array_repeat(F.lit(True), times.cast("int")), F.when((part > 0) & (part < F.col(size)), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    rows = rows.withColumn(whole, F.explode(kinds))
    word = f"(({first} + i) div {block_tokens})"
    picked = f"(({word} + 1) * {rest} + {start}) div {blocks} - ({word} * {rest} + {start}) div {blocks} = 1"
    rows = rows.withColumn(words, F.when(~F.col(whole), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    text = F.when(F.col(whole), F.col("text")).otherwise(F.array_join(F.expr(f"filter({words}, (w, i) -> {picked})"), " "))
    rows = rows.withColumn("text", text)
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(whole), F.col("n_chars")).otherwise(F.char_length("text").cast(dict(documents.dtypes)["n_chars"])))
    return rows.select(*documents.columns)
