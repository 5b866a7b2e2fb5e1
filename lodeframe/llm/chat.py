"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template, one turn after another:  ``### role: text</turn>`` and a line feed.  A turn ends at
``</turn>`` and a line feed; its role ends at the first ``: ``.  The parser splits at those marks and
then drops one backslash before any of backslash, ``#``, ``/`` and blank, from left to right.

A conversation is first rendered as it is and read back.  Where the turns that come back differ
from the source, its texts are escaped (backslashes doubled, ``##`` and ``</turn>`` broken up by a
backslash) and it is read back again; were that not identical either, the query would fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, END = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    """Doubles backslashes, then breaks up every ``##`` and ``</turn>``; ``unescape`` undoes it exactly."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, "#(?=#)", "#\\\\")
    return F.regexp_replace(text, "<(?=/turn>)", "<\\\\")


def escape_role(role: Column) -> Column:
    """As ``escape``, and ``: `` is broken up as well."""
    return F.regexp_replace(escape(role), ":(?= )", ":\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/ ])", "$1")


def render(turns: Column, escaped: bool) -> Column:
    """turns array<struct<role, text>> -> text of the conversation."""
    role, text = (escape_role, escape) if escaped else (lambda c: c, lambda c: c)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), role(t["role"]), F.lit(ROLE_END), text(t["text"]), F.lit(END))), "")


def running_starts(lengths: Column, block: int = 256) -> Column:
    """Where each of consecutive pieces begins, counted from 1, given their lengths.

    An array grows by copying, so sums run inside blocks, and over the blocks' totals before: work is in proportion to the pieces times
    ``block``, and not to their square.
    """
    none = F.array().cast("array<int>")

    def run(values: Column, first: Column) -> Column:
        state = F.struct(none.alias("at"), first.alias("next"))
        return F.aggregate(values, state, lambda acc, n: F.struct(F.array_append(acc["at"], acc["next"]).alias("at"), (acc["next"] + n).alias("next")))["at"]

    def in_blocks(lengths: Column) -> Column:
        firsts = F.when(F.size(lengths) > 0, F.sequence(F.lit(1), F.size(lengths), F.lit(block))).otherwise(none)
        totals = F.transform(firsts, lambda k: F.aggregate(F.slice(lengths, k, F.lit(block)), F.lit(0), lambda acc, n: acc + n))
        return F.flatten(F.zip_with(firsts, run(totals, F.lit(1)), lambda k, start: run(F.slice(lengths, k, F.lit(block)), start)))

    return with_value(lengths, lambda ls: F.when(F.size(ls) <= block, run(ls, F.lit(1))).otherwise(in_blocks(ls)))


def with_value(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parse(formatted: Column) -> Column:
    """Text of a conversation -> turns array<struct<role, text, start, length>>; start counts from 1 in ``formatted``.

    start and length tell where the turn's text, as written there, stands.  The end mark of the last turn leaves an
    empty last piece, which is dropped.
    """
    pieces = F.split(formatted, F.lit(END), -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    begins = F.transform(pieces, lambda p: F.struct(p.alias("piece"), F.position(F.lit(ROLE_END), p).alias("colon"), (F.char_length(p) + len(END)).alias("length")))

    def turns(begins: Column) -> Column:
        return F.zip_with(
            begins,
            running_starts(F.transform(begins, lambda b: b["length"])),
            lambda b, at: F.struct(
                unescape(F.substring(b["piece"], F.lit(len(OPEN) + 1), b["colon"] - len(OPEN) - 1)).alias("role"),
                unescape(F.substring(b["piece"], b["colon"] + len(ROLE_END), b["length"])).alias("text"),
                (at + b["colon"] + len(ROLE_END) - 1).alias("start"),
                (b["length"] - len(END) - b["colon"] - len(ROLE_END) + 1).alias("length"),
            ),
        )

    return with_value(begins, turns)


def only_turns(parsed: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, formatted, loss_spans array<struct<start, length>>, escaped, n_turns).

    loss_spans are the character ranges of ``formatted`` (from 1) that carry loss: the texts of ``loss_role``.
    Null role or text: empty.  A null conv_id is a conversation of its own.  Rows of one turn number are ordered by role,
    then text; repeated rows stay repeated; a null turn comes first.  An empty table gives an empty result; further columns
    are ignored.  A conversation is one value of the result, so its turns meet in one task by nature.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("at", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    # array_sort puts null fields last, so a null turn gets the smallest number and its own flag.
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn")).alias("at")
    chats = conversations.select("conv_id", at, role, text).groupBy("conv_id").agg(turns.alias("turns"))
    chats = chats.withColumn("plain", render(F.col("turns"), False))
    chats = chats.withColumn("escaped", ~(only_turns(parse(F.col("plain"))) == F.col("turns")))
    chats = chats.withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("plain")))
    chats = chats.withColumn("parsed", parse(F.col("formatted")))
    same = only_turns(F.col("parsed")) == F.col("turns")
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("conversation does not survive its round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    spans = F.transform(F.filter("parsed", lambda t: t["role"] == loss_role), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return chats.select("conv_id", checked.alias("formatted"), spans.alias("loss_spans"), "escaped", F.size("turns").cast("long").alias("n_turns"))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")
