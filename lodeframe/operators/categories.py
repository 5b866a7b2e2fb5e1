"""Categorical columns: counts, summaries, grouped statistics, cross-tabulation and agreement.

Caps of the reporting tables are applied after complete counting, in order of count and label, and
are flagged; nothing is left uncounted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.text import numbered
from .statistics import group_key, moments, valid_weight

CATEGORIES, GROUPS, LABELS = 500, 500, 200
MISSING = "∅"


def category(name: str) -> Column:
    """A category's text; empty text is null."""
    return F.when(F.col(name).cast("string") != "", F.col(name).cast("string"))


def full_counts(df: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """(column, [group,] value, n) of all values of each column."""
    keys = ["column", *(["group"] if group else [])]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), category(c).alias("value")) for c in columns]))
    rows = df.select(*([group_key(group).alias("group")] if group else []), pairs.alias("p")).select(*(["group"] if group else []), "p.column", "p.value")
    return rows.where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))


def counts(df: DataFrame, columns: list[str], group: str | None = None, cap: int = CATEGORIES) -> DataFrame:
    """(column, [group,] value, n, overflow): the ``cap`` commonest values of each column; overflow tells that there are more."""
    keys = ["column", *(["group"] if group else [])]
    n = full_counts(df, columns, group)
    n = n.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "value"))).where(F.col("place") <= cap + 1)
    more = F.max("place").over(Window.partitionBy(*keys)) > cap
    return n.withColumn("overflow", more).where(F.col("place") <= cap).select(*keys, "value", "n", "overflow")


def pareto(df: DataFrame, columns: list[str], cap: int = CATEGORIES) -> DataFrame:
    """(column, value, n, place, share, cumulative, overflow): shares of all rows in percent, commonest first; only the listing is capped."""
    n = counts(df, columns, cap=cap).crossJoin(F.broadcast(df.agg(F.count("*").alias("rows"))))  # one row
    by = Window.partitionBy("column").orderBy(F.desc("n"), "value")  # at most ``cap`` rows a column
    running = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return n.select("column", "value", "n", F.row_number().over(by).alias("place"), (F.col("n") * 100.0 / F.col("rows")).alias("share"), (running * 100.0 / F.col("rows")).alias("cumulative"), "overflow")


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct, rows, nulls, dominant, dominant_pct, entropy, max_entropy, diversity_pct, covering_80) over all values.

    Values of one count are summed together before anything is ordered: k different counts need k (k + 1) / 2 rows at least,
    so the ordered table is small for any number of values.
    """
    n = full_counts(df, columns)
    levels = n.groupBy("column", "n").agg(F.count("*").alias("k"), F.min("value").alias("value"))
    by = Window.partitionBy("column").orderBy(F.desc("n"))
    levels = levels.withColumn("all", F.sum(F.col("n") * F.col("k")).over(Window.partitionBy("column")))
    levels = levels.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("k")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Of the k values of a count, those are needed before which less than 80 % is covered.
    needed = F.least(F.greatest(F.ceil((0.8 * F.col("all") - F.col("before")) / F.col("n")), F.lit(0)), F.col("k"))
    s = F.col("n") / F.col("all")
    out = levels.groupBy("column").agg(
        F.sum("k").alias("distinct"),
        F.first("all").alias("counted"),
        F.max_by("value", "n").alias("dominant"),
        F.max(s).alias("top"),
        (-F.sum(F.col("k") * s * F.log2(s))).alias("entropy"),
        F.sum(needed).cast("long").alias("covering_80"),
    )
    out = out.crossJoin(F.broadcast(df.agg(F.count("*").alias("rows"))))  # one row
    most = F.log2(F.col("distinct").cast("double"))
    return out.select(
        "column", "distinct", "rows", (F.col("rows") - F.col("counted")).alias("nulls"), "dominant", (F.col("top") * 100).alias("dominant_pct"),
        "entropy", most.alias("max_entropy"), F.coalesce(F.floor(F.try_divide(F.col("entropy"), most) * 100 + 0.5), F.lit(0)).alias("diversity_pct"), "covering_80",
    )


#: Up to how many categories a chart shows all, and how many it shows beyond that.
SHOW_ALL, SHOW_TOP = 30, 20


#: Collation of labels: the root order of Unicode, by base letter, then accent, then case.
COLLATION = "UNICODE"


def _order_keys(mode: str, order: list[str] | None, column: str) -> list[Column]:
    value = F.col(column)
    # Labels that the collation holds equal go by their code points.
    spelled = [F.collate(value, COLLATION), value]
    ranked = F.array(*[F.lit(v) for v in order or []]).cast("array<string>")
    place = F.nullif(F.array_position(ranked, value), F.lit(0))
    keys = {
        "count-desc": [F.desc("n"), value], "count-asc": [F.asc("n"), value], "alpha": [value == MISSING, *spelled],
        "missing-last": [value == MISSING, *spelled], "custom": [place.asc_nulls_last(), F.desc("n"), value],
    }
    if mode not in keys:
        raise ValueError(f"unknown order {mode!r}")
    return keys[mode]


def in_order(counted: DataFrame, mode: str = "count-desc", order: list[str] | None = None, column: str = "value") -> DataFrame:
    """Rows of ``counts`` sorted by count-desc, count-asc, alpha, missing-last or custom; equal counts go by value.

    custom puts the listed values first, in their order, then all others by falling count.  alpha, or missing-last, is the order of a
    dictionary (``COLLATION``), in which accents and case tell apart only labels that are equal without, the missing label at the end.
    """
    return counted.orderBy(*_order_keys(mode, order, column))


def with_place(counted: DataFrame, mode: str = "count-desc", order: list[str] | None = None, column: str = "value", name: str = "place") -> DataFrame:
    """The rows with their number, from 1, in an order of ``in_order``, for results that have to keep it; sorted in ranges, however many there are."""
    return numbered(in_order(counted, mode, order, column), name).withColumn(name, F.col(name) + 1)


def shown(counted: DataFrame) -> DataFrame:
    """What a chart of one column shows: all of up to 30 values, else the 20 commonest."""
    top = in_order(counted).limit(SHOW_ALL + 1).withColumn("__i", F.row_number().over(Window.orderBy(F.desc("n"), "value")))
    top = top.withColumn("__of", F.count("*").over(Window.partitionBy()))  # at most 31 rows
    return top.where((F.col("__of") <= SHOW_ALL) | (F.col("__i") <= SHOW_TOP)).drop("__i", "__of")


def grouped_statistics(df: DataFrame, variables: list[str], group: str, weight: str | None = None, cap: int = GROUPS) -> DataFrame:
    """``moments`` by group for the ``cap`` largest groups, with overflow where there are more."""
    sizes = df.groupBy(group_key(group).alias("group")).agg(F.count("*").alias("size"))
    sizes = sizes.orderBy(F.desc("size"), "group").limit(cap + 1).withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "group")))
    sizes = sizes.withColumn("overflow", F.max("place").over(Window.partitionBy()) > cap).where(F.col("place") <= cap)
    return moments(df, variables, weight, group).join(F.broadcast(sizes.select("group", "overflow")), "group")  # at most ``cap`` rows


def _labels(df: DataFrame, a: str, b: str, weight: str | None) -> DataFrame:
    label = lambda c: F.coalesce(F.when(group_key(c) != "", group_key(c)), F.lit(MISSING))
    return df.select(label(a).alias("a"), label(b).alias("b"), valid_weight(weight).alias("w"))


def crosstab_cells(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """(a, b, n, w): count and weight of every pair of labels, none left out; a missing label is the empty set sign.

    Rows with an invalid weight are left out.  Margins, shares and agreement are taken from these cells.
    """
    return _labels(df, a, b, weight).where("w is not null").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def crosstab(df: DataFrame, a: str, b: str, weight: str | None = None, cap: int = LABELS) -> DataFrame:
    """(a, b, n, w, overflow): the cells to list, those of the ``cap`` commonest labels of either axis.

    overflow tells that an axis has more labels; their rows are counted in ``crosstab_tallies`` and in everything made from ``crosstab_cells``.
    """
    cells = crosstab_cells(df, a, b, weight)
    out, more = cells, F.lit(False)
    for axis in ("a", "b"):
        top = cells.groupBy(axis).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), axis).limit(cap + 1)
        top = top.withColumn("i", F.row_number().over(Window.orderBy(F.desc("t"), axis))).withColumn(f"more_{axis}", F.max("i").over(Window.partitionBy()) > cap)
        out = out.join(F.broadcast(top.where(F.col("i") <= cap).select(axis, f"more_{axis}")), axis)  # at most ``cap`` rows
        more = more | F.col(f"more_{axis}")
    return out.select("a", "b", "n", "w", more.alias("overflow"))


def crosstab_tallies(df: DataFrame, a: str, b: str, weight: str | None = None, where: Column | None = None, cap: int = LABELS) -> DataFrame:
    """One row: total, kept, placed, a_missing, b_missing, weight_excluded, weight_total, a_labels, b_labels, a_overflow, b_overflow.

    kept passes the local filter ``where``; placed has a valid weight too; the missing labels are counted among kept rows.
    """
    passes = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    rows = df.agg(F.count("*").alias("total"))
    kept = _labels(df.where(passes), a, b, weight)
    ok = F.col("w").isNotNull()
    tallies = kept.agg(
        F.count("*").alias("kept"), F.count_if(ok).alias("placed"), F.count_if(F.col("a") == MISSING).alias("a_missing"), F.count_if(F.col("b") == MISSING).alias("b_missing"),
        F.count_if(~ok).alias("weight_excluded"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("weight_total"),
    )
    out = rows.crossJoin(F.broadcast(tallies))  # one row each
    for axis in ("a", "b"):
        n = kept.where(ok).select(axis).distinct().agg(F.count("*").alias(f"{axis}_labels"))
        out = out.crossJoin(F.broadcast(n)).withColumn(f"{axis}_overflow", F.col(f"{axis}_labels") > cap)  # one row
    return out


def crosstab_shares(cells: DataFrame, by: str = "n") -> DataFrame:
    """(a, b, count, row_pct, col_pct, total_pct) of crosstab cells; totals are aggregated and joined, no axis is gathered in a task."""
    v = F.col(by)
    rows, columns = (cells.groupBy(axis).agg(F.sum(by).alias(f"of_{axis}")) for axis in ("a", "b"))
    out = cells.join(rows, "a").join(columns, "b").crossJoin(F.broadcast(cells.agg(F.sum(by).alias("of_all"))))  # one row
    pct = lambda total: F.try_divide(v * 100.0, F.col(total))
    return out.select("a", "b", v.alias("count"), pct("of_a").alias("row_pct"), pct("of_b").alias("col_pct"), pct("of_all").alias("total_pct"))


def margins(cells: DataFrame, by: str = "n") -> DataFrame:
    """(a, b, total): row totals (b null), column totals (a null) and the grand total (both null)."""
    return cells.cube("a", "b").agg(F.sum(by).alias("total"), F.grouping_id("a", "b").alias("level")).where("level > 0").select("a", "b", "total")


def agreement(cells: DataFrame, by: str = "n") -> DataFrame:
    """(total, po, pe, kappa, band) of two labellings: Cohen's kappa over the union of labels."""
    v = F.col(by).cast("double")
    both = cells.select(F.explode(F.array(F.struct(F.col("a").alias("k"), v.alias("r"), F.lit(0.0).alias("c")), F.struct(F.col("b").alias("k"), F.lit(0.0).alias("r"), v.alias("c")))).alias("s"), "a", "b", v.alias("v"))
    per = both.groupBy("s.k").agg(F.sum("s.r").alias("r"), F.sum("s.c").alias("c"))
    chance = per.agg(F.sum(F.col("r") * F.col("c")).alias("rc"), F.sum("r").alias("total"))
    same = cells.agg(F.sum(F.when(F.col("a") == F.col("b"), v).otherwise(0.0)).alias("diagonal"))
    out = chance.crossJoin(F.broadcast(same))  # one row each
    po, pe = F.try_divide(F.col("diagonal"), F.col("total")), F.try_divide(F.col("rc"), F.col("total") * F.col("total"))
    out = out.select("total", po.alias("po"), pe.alias("pe"))
    out = out.withColumn("kappa", F.when(1 - F.col("pe") > 1e-12, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))))
    k = F.col("kappa")
    band = F.when(k < 0, "poor").when(k < 0.2, "slight").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").when(k >= 0.8, "almost perfect")
    return out.withColumn("band", band)


def compare(primary: DataFrame, other: DataFrame, column: str, other_column: str | None = None) -> DataFrame:
    """(value, n_primary, share_primary, n_other, share_other): values of either dataset with their counts and shares in percent."""

    def shares(df: DataFrame, name: str, tag: str) -> DataFrame:
        n = df.select(category(name).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias(f"n_{tag}"))
        total = n.agg(F.sum(f"n_{tag}").alias("t"))
        return n.crossJoin(F.broadcast(total)).select("value", f"n_{tag}", (F.col(f"n_{tag}") * 100.0 / F.col("t")).alias(f"share_{tag}"))  # one row

    both = shares(primary, column, "primary").join(shares(other, other_column or column, "other"), "value", "full_outer")
    return both.fillna(0, [f"{k}_{t}" for k in ("n", "share") for t in ("primary", "other")])


def category_filter(chosen: dict[str, list[str]]) -> Column:
    """Any of the chosen values within a column, all columns together."""
    out = F.lit(True)
    for name, values in chosen.items():
        if values:
            out = out & F.coalesce(F.col(name).cast("string").isin(*values), F.lit(False))
    return out
