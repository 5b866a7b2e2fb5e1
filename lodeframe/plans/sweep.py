"""State carried along an order within keys, for as-of lookups and sweeps over events, where a key may hold any share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import dealt, small, spare_names

#: Rows of a key above which it is cut in ranges of about as many, and ranges that one key has at most.
RANGE_ROWS, MOST_RANGES = 200_000, 10_000
#: Groups of keys that are counted before single keys are.
KEY_GROUPS = 65_536


def cuts_of(rows: DataFrame, key: str, at: str, range_rows: int = RANGE_ROWS) -> DataFrame | None:
    """(key, __cuts) of the keys with more than ``range_rows`` rows: places by ``at`` where to cut them; None if there is no such key."""
    return sized(rows, key, at, range_rows)[1]


def sized(rows: DataFrame, key: str, at: str, range_rows: int = RANGE_ROWS) -> tuple[int, DataFrame | None]:
    """The number of rows, and ``cuts_of`` them.  Keys are counted one by one only where a group of them, told by a hash, has that many rows."""
    group = F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS))
    groups = rows.groupBy(group.alias("group")).agg(F.count("*").alias("n"))
    total, most = groups.agg(F.sum("n"), F.max("n")).first()
    if (most or 0) <= range_rows:
        return total or 0, None
    full = small(groups.where(F.col("n") > range_rows).select("group"))
    rows = rows.join(full, group == F.col("group"), "left_semi")
    return total, _cuts(rows, key, at, range_rows)


def _cuts(rows: DataFrame, key: str, at: str, range_rows: int) -> DataFrame | None:
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 0
    if largest <= range_rows:
        return None
    many = small(counts.where(F.col("n") > range_rows))
    parts = min(MOST_RANGES, math.ceil(largest / range_rows))
    shares = [k / parts for k in range(1, parts)]
    cuts = rows.join(many.select(key), key, "left_semi").groupBy(key).agg(F.percentile_approx(at, shares, max(1000, 4 * parts)).alias("__cuts"))
    return small(cuts.withColumn("__cuts", F.array_sort(F.array_distinct("__cuts"))), max(1, 1_000_000 // parts))


def swept(rows: DataFrame, keys: list[str], order: list[str], held: tuple[str, ...] = (), summed: tuple[str, ...] = (), topped: tuple[str, ...] = (), following: str | None = None, cuts: DataFrame | None = None) -> DataFrame:
    """The rows with what came before them in their key, in order of ``order``, whose first column is a place.

    held        columns that become their last non-null value up to the row
    summed      columns that become their sum up to the row
    topped      columns c for which c_before is their maximum before the row
    following   name of a column for the place of the next row

    ``cuts`` of the first key split keys of many rows: each range is a window of its own, and what a range leaves behind is summed up in one
    row and handed to the ranges after it.  Rows of one place stay together.  Keys must not be null.
    """
    at = order[0]
    if cuts is None:
        return _inside(rows, Window.partitionBy(*keys).orderBy(*order), at, held, summed, topped, following)
    part, own_cuts, own_key, first, nxt = spare_names(rows, "range", "cuts", "key", "first", "next")
    cuts = cuts.select(F.col(cuts.columns[0]).alias(own_key), F.col("__cuts").alias(own_cuts))
    placed = rows.join(cuts, F.col(keys[0]) == F.col(own_key), "left").drop(own_key)
    placed = placed.withColumn(part, F.coalesce(F.size(F.filter(own_cuts, lambda c: c < F.col(at))), F.lit(0)))
    left = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"__h{i}") for i, c in enumerate(held)]
    left += [F.sum(c).alias(f"__s{i}") for i, c in enumerate(summed)] + [F.max(c).alias(f"__t{i}") for i, c in enumerate(topped)]
    parts = placed.where(F.col(own_cuts).isNotNull()).groupBy(*keys, part).agg(F.min(at).alias(first), *left)
    by = Window.partitionBy(*keys).orderBy(part)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"__h{i}", ignorenulls=True).over(before).alias(f"__h{i}") for i in range(len(held))]
    carried += [F.sum(f"__s{i}").over(before).alias(f"__s{i}") for i in range(len(summed))] + [F.max(f"__t{i}").over(before).alias(f"__t{i}") for i in range(len(topped))]
    carried = small(parts.select(*keys, part, F.lead(first).over(by).alias(nxt), *carried))
    inside = _inside(placed.drop(own_cuts), Window.partitionBy(*keys, part).orderBy(*order), at, held, summed, topped, following)
    joined = inside.join(carried, [*keys, part], "left")
    new: dict[str, Column] = {c: F.coalesce(F.col(c), F.col(f"__h{i}")) for i, c in enumerate(held)}
    new |= {c: F.col(c) + F.coalesce(F.col(f"__s{i}"), F.lit(0)) for i, c in enumerate(summed)}
    new |= {f"{c}_before": F.greatest(F.col(f"{c}_before"), F.col(f"__t{i}")) for i, c in enumerate(topped)}
    if following:
        new[following] = F.coalesce(F.col(following), F.col(nxt))
    return joined.withColumns(new).select(*[c for c in inside.columns if c != part])


def _inside(rows: DataFrame, by, at: str, held, summed, topped, following) -> DataFrame:
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    new = {c: F.last(c, ignorenulls=True).over(upto) for c in held} | {c: F.sum(c).over(upto) for c in summed} | {f"{c}_before": F.max(c).over(before) for c in topped}
    return rows.withColumns(new | ({following: F.lead(at).over(by)} if following else {}))


def as_of(asked: DataFrame, marks: DataFrame, key: str, at: str, mark: str, range_rows: int = RANGE_ROWS, few_marks: bool = False) -> DataFrame:
    """asked(key, at, ...), marks(key, at, mark) -> asked with the ``mark`` of the last mark at or before each row's place; rows without one fall away.

    Both are laid in one line by place, marks first, and the last mark is carried on: every row stands there once, and no row is paired
    with the marks of its key.  Null keys and places match nothing.  Keys are cut by their rows and marks; where marks are known to be
    ``few_marks`` a key, by the rows alone, which spares computing the marks twice.
    """
    own_key, place, asks, held = spare_names(asked, "key", "place", "asks", "mark")
    line = rows = asked.withColumns({own_key: F.col(key), place: F.col(at).cast("double"), asks: F.lit(1)})
    line = line.unionByName(marks.select(F.col(key).alias(own_key), F.col(at).cast("double").alias(place), F.lit(0).alias(asks), F.col(mark).alias(held)), allowMissingColumns=True)
    line = line.where(F.col(own_key).isNotNull() & F.col(place).isNotNull())
    counted = (rows if few_marks else line).select(own_key, place)
    n, cuts = sized(counted, own_key, place, range_rows)
    if cuts is None:
        line = dealt(line, own_key, rows=n, whole=not few_marks)
    done = swept(line, [own_key], [place, asks], held=(held,), cuts=cuts)
    return done.where((F.col(asks) == 1) & F.col(held).isNotNull()).select(*asked.columns, F.col(held).alias(mark))
