"""Univariate statistics: moments, quantiles, distribution points and comparisons.

Results are in long form, one row per variable (and group).  NULL, NaN and infinite values are
nulls of their variable only; a row whose weight is missing, not finite or not above zero is left
out whole and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, normal_score
from ..plans.levels import levels_passed
from ..plans.prefix import running_totals
from .states import COMPRESSION, EXACT_VALUES, digest_states, merge_digests, merge_moments, moment_states

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def value_of(name: str, skip_zeros: bool = False, skip_negatives: bool = False) -> Column:
    """A column's accepted value: finite, and not one of those that its value filter skips."""
    v = finite(F.col(name))
    if skip_zeros:
        v = F.when(v == 0, None).otherwise(v)
    if skip_negatives:
        v = F.when(v < 0, None).otherwise(v)
    return v


def valid_weight(weight: str | Column | None) -> Column:
    """Weight above zero, NULL where the row is to be left out; 1 without a weight column."""
    if weight is None:
        return F.lit(1.0)
    w = finite(F.col(weight) if isinstance(weight, str) else weight)
    return F.when(w > 0, w)


def _unfold(wide: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """One struct column per variable -> one row per variable."""
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"__{i}").alias("s")) for i, v in enumerate(variables)])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.variable", "r.s.*")


def moments(df: DataFrame, variables: list[str], weight: str | None = None, group: str | None = None, skip_zeros: tuple[str, ...] = (), skip_negatives: tuple[str, ...] = ()) -> DataFrame:
    """(variable[, group], count, nulls, zeros, sum_w, min, max, mean, std, skew, kurt, cv).

    Unweighted: sample standard deviation, and skewness and kurtosis corrected for sample size, by Spark's own aggregates.
    Weighted: population forms, from states of central moments that tasks make and merge (``states``).  Either way every row is read
    once.  std needs 2 values, skew 3 and kurt 4.
    """
    if weight is not None:
        return moments_of(merge_moments(states_of_moments(df, variables, weight, group, skip_zeros, skip_negatives)))
    keys = ["group"] if group else []
    base = _values(df, variables, None, group, skip_zeros, skip_negatives)
    w = F.col("__w")

    def plain(v: Column) -> list[Column]:
        return [
            F.count(v).alias("count"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v == 0).alias("zeros"), F.sum(F.when(v.isNotNull(), w)).alias("sum_w"),
            F.min(v).alias("min"), F.max(v).alias("max"), F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))).alias("mean"),
            F.stddev_samp(v).alias("s"), F.when(F.max(v) > F.min(v), F.skewness(v)).alias("g1"), F.when(F.max(v) > F.min(v), F.kurtosis(v)).alias("g2"),
        ]

    wide = base.groupBy(*keys).agg(*[F.struct(*plain(F.col(f"__v{i}"))).alias(f"__{i}") for i in range(len(variables))])
    n = F.col("count").cast("double")
    out = _unfold(wide, keys, variables)
    skew = F.col("g1") * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return _shown(out, keys, F.col("s"), skew, kurt, F.col("max") > F.col("min"))


def _values(df: DataFrame, variables: list[str], weight: str | None, group: str | None, skip_zeros: tuple[str, ...] = (), skip_negatives: tuple[str, ...] = ()) -> DataFrame:
    """([group,] __w, __v0, __v1, ...) of the rows with a valid weight."""
    values = [value_of(v, v in skip_zeros, v in skip_negatives).alias(f"__v{i}") for i, v in enumerate(variables)]
    return df.select(*([group_key(group).alias("group")] if group else []), valid_weight(weight).alias("__w"), *values).where("__w is not null")


def _shown(rows: DataFrame, keys: list[str], std: Column, skew: Column, kurt: Column, varies: Column) -> DataFrame:
    n = F.col("count")
    out = rows.withColumn("std", F.when(n >= 2, std)).withColumn("skew", F.when((n > 2) & varies, skew)).withColumn("kurt", F.when((n > 3) & varies, kurt))
    cv = F.when((F.col("mean") != 0) & (F.col("std") != 0), F.abs(F.col("std") / F.col("mean") * 100))
    return out.withColumn("cv", cv).select("variable", *keys, "count", "nulls", "zeros", "sum_w", "min", "max", "mean", "std", "skew", "kurt", "cv")


def states_of_moments(df: DataFrame, variables: list[str], weight: str | None = None, group: str | None = None, skip_zeros: tuple[str, ...] = (), skip_negatives: tuple[str, ...] = ()) -> DataFrame:
    """States of the variables' central moments by weight, several rows of each: to be kept, joined with those of other data and merged."""
    return moment_states(_values(df, variables, weight, group, skip_zeros, skip_negatives), variables, group is not None)


def moments_of(states: DataFrame) -> DataFrame:
    """Merged states -> the columns of ``moments``, in population forms."""
    keys = ["group"] if "group" in states.columns else []
    m2, m3, m4, w = (F.col(c) for c in ("m2", "m3", "m4", "w"))
    out = states.withColumn("mean", F.when(F.col("count") > 0, finite(F.col("m1")))).withColumn("sum_w", F.when(F.col("count") > 0, w))
    return _shown(out, keys, finite(F.sqrt(F.try_divide(m2, w))), finite(F.try_divide(F.sqrt(w) * m3, F.pow(m2, F.lit(1.5)))), finite(F.try_divide(w * m4, m2 * m2) - 3), m2 > 0)


def group_key(name: str) -> Column:
    """Text of a group: whole numbers without a fraction, NULL as empty text."""
    c = F.col(name)
    as_text = c.cast("string")
    d = c.try_cast("double")
    whole = F.when(F.regexp_like(as_text, F.lit(r"^-?\d+\.0$")), d.cast("long").cast("string")).otherwise(as_text)
    return F.coalesce(whole, F.lit(""))


def weighted_cells(df: DataFrame, variable: str, weight: str | None = None, group: str | None = None) -> DataFrame:
    """Distinct values with their summed weights: ([group,] value, c)."""
    keys = [group_key(group).alias("group")] if group else []
    rows = df.select(*keys, value_of(variable).alias("value"), valid_weight(weight).alias("w")).where("value is not null and w is not null")
    return rows.groupBy(*(["group"] if group else []), "value").agg(F.sum("w").alias("c"))


def _at_levels(cells: DataFrame, keys: list[str], at: tuple[float, ...], low, high) -> DataFrame:
    """Each cell with those of the levels q between its bounds: rows are as many as levels (and groups), not cells times levels.

    low and high: whether the weight q * total lies before the cell's lower and before its upper bound.
    """
    qs = sorted({float(q) for q in at})
    before = F.when(F.col("prev_value").isNull(), F.lit(0)).otherwise(levels_passed(qs, low))
    upto = F.when(F.col("last"), F.lit(len(qs))).otherwise(levels_passed(qs, high))
    rows = cells.withColumn("__i", before).withColumn("__n", upto - F.col("__i")).where("__n > 0")
    return rows.withColumn("q", F.explode(F.slice(F.array(*[F.lit(q) for q in qs]), F.col("__i") + 1, F.col("__n")))).drop("__i", "__n")


def quantiles(df: DataFrame, variable: str, at: tuple[float, ...] = QUANTILES, weight: str | None = None, group: str | None = None) -> DataFrame:
    """([group,] q, value): interpolated between the mid-points of the distinct values' weights.

    A value's mid-point is the weight below it plus half its own.  Below the first mid-point it is the first value,
    from the last on the last.
    """
    return quantiles_of(weighted_cells(df, variable, weight, group), ["group"] if group else [], at)


def quantiles_of(cells: DataFrame, keys: list[str], at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """cells(keys, value, c) -> (keys, q, value), the same of values with weights that are known already."""
    cells = running_totals(cells, keys, "value", "c")
    cells = cells.withColumn("mid", F.col("cum") - F.col("c") / 2).withColumn("prev_mid", F.col("cum") - F.col("c") - F.col("prev_amount") / 2)
    # A level at a bound is met by both neighbours, whatever the rounding of sums; they agree there.
    slack = F.col("total") * 1e-12
    rows = _at_levels(cells, keys, at, lambda q: q * F.col("total") < F.col("prev_mid") - slack, lambda q: q * F.col("total") < F.col("mid") + slack)
    part = F.try_divide(F.col("q") * F.col("total") - F.col("prev_mid"), F.col("mid") - F.col("prev_mid"))
    between = F.col("prev_value") + (F.col("value") - F.col("prev_value")) * F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
    value = F.when(F.col("prev_value").isNull() | (F.col("last") & (F.col("q") >= 1)), F.col("value")).otherwise(between)
    return rows.groupBy(*keys, "q").agg(F.max(value).alias("value"))


def step_percentiles(df: DataFrame, variable: str, at: tuple[float, ...], weight: str | None = None, group: str | None = None) -> DataFrame:
    """([group,] q, value): the first value whose cumulative weight reaches q of the total, without interpolation."""
    keys = ["group"] if group else []
    cells = running_totals(weighted_cells(df, variable, weight, group), keys, "value", "c")
    slack = F.col("total") * 1e-12
    rows = _at_levels(cells, keys, at, lambda q: q * F.col("total") <= F.col("cum") - F.col("c") - slack, lambda q: q * F.col("total") <= F.col("cum") + slack)
    reached = F.when((F.col("cum") >= F.col("q") * F.col("total")) | F.col("last"), F.col("value"))
    return rows.groupBy(*keys, "q").agg(F.min(reached).alias("value"))


def digest(df: DataFrame, variables: list[str], weight: str | None = None, group: str | None = None, exact_values: int = EXACT_VALUES, compression: float = COMPRESSION) -> DataFrame:
    """(variable[, group], mean, weight, exact): the variables' distributions as centroids, in one pass over the rows.

    Up to ``exact_values`` distinct values a digest holds each of them; beyond that, centroids whose weight is bounded by
    4 W q (1 - q) / ``compression``, so tails keep single values.  Digests of several tables, or of a table and what was added later, are
    merged with ``merge_digests(a.unionByName(b))``; the result does not depend on how rows were dealt to tasks while it is exact,
    and beyond that within its bound.
    """
    states = digest_states(_values(df, variables, weight, group), variables, group is not None, exact_values, compression)
    return merge_digests(states, exact_values, compression)


def digest_quantiles(digested: DataFrame, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(variable[, group], q, value): a digest's quantiles, interpolated as in ``quantiles`` and equal to those while it is exact."""
    keys = [c for c in ("variable", "group") if c in digested.columns]
    return quantiles_of(digested.select(*keys, F.col("mean").alias("value"), F.col("weight").alias("c")), keys, at)


def approximate_quantiles(df: DataFrame, variable: str, at: tuple[float, ...] = QUANTILES, group: str | None = None, accuracy: int = 10_000) -> DataFrame:
    """([group,] q, value) from Spark's own sketch, for a column without weights: one partial aggregate, no sort; relative rank error 1 / accuracy."""
    keys = ["group"] if group else []
    rows = df.select(*([group_key(group).alias("group")] if group else []), value_of(variable).alias("v"))
    out = rows.groupBy(*keys).agg(F.percentile_approx("v", [float(x) for x in at], accuracy).alias("p"))
    return out.select(*keys, F.posexplode("p").alias("i", "value")).select(*keys, F.element_at(F.array(*[F.lit(float(x)) for x in at]), F.col("i") + 1).alias("q"), "value")


def shares_at(cells: DataFrame, values: tuple[float, ...], keys: list[str] = [], log: bool = False) -> DataFrame:  # noqa: B006
    """cells(keys, value, c), of ``weighted_cells`` or of a digest -> (keys, at, share): cumulative share of weight at given values.

    Between two distinct values the share is interpolated; at or below the first one it is 0, from the last one on 1.  log: values
    of 0 or less are no points, but their weight counts.
    """
    cells = running_totals(cells, keys, "value", "c")
    if log:
        cells = cells.where("value > 0").withColumn("prev_value", F.when(F.col("prev_value") > 0, F.col("prev_value")))
    rows = _at_levels(cells, keys, values, lambda x: x <= F.col("prev_value"), lambda x: x <= F.col("value"))
    share, below = F.col("cum") / F.col("total"), (F.col("cum") - F.col("c")) / F.col("total")
    part = F.try_divide(F.col("q") - F.col("prev_value"), F.col("value") - F.col("prev_value"))
    at = F.when(F.col("q") > F.col("value"), share).when(F.col("prev_value").isNull(), F.when(F.col("q") <= F.col("value"), 0.0)).otherwise(below + part * (share - below))
    return rows.select(*keys, F.col("q").alias("at"), at.alias("share"))


def cdf_points(df: DataFrame, variable: str, weight: str | None = None, log: bool = False) -> DataFrame:
    """(value, share): cumulative share of weight at every distinct value; log leaves out values of 0 or less but keeps their weight."""
    cells = running_totals(weighted_cells(df, variable, weight), [], "value", "c")
    cells = cells.where("value > 0") if log else cells
    return cells.select("value", (F.col("cum") / F.col("total")).alias("share"))


def qq_pairs(a: DataFrame, variable_a: str, b: DataFrame, variable_b: str, at: tuple[float, ...] = tuple(k / 100 for k in range(1, 100)), weight_a: str | None = None, weight_b: str | None = None) -> DataFrame:
    """(q, a, b): quantiles of two distributions at the same shares."""
    left = quantiles(a, variable_a, at, weight_a).select("q", F.col("value").alias("a"))
    return left.join(quantiles(b, variable_b, at, weight_b).select("q", F.col("value").alias("b")), "q")


def log_probability_points(df: DataFrame, variable: str, weight: str | None = None) -> DataFrame:
    """(value, p, score) of positive values: share at the mid-point of each value's weight and its normal score."""
    cells = running_totals(weighted_cells(df, variable, weight), [], "value", "c").where("value > 0")
    return cells.withColumn("p", (F.col("cum") - F.col("c") / 2) / F.col("total")).select("value", "p", normal_score(F.col("p")).alias("score"))


#: Metrics that have no meaningful relative difference.
NOT_COMPARED = ("count", "sum_w", "nulls", "zeros", "skew", "kurt")


def relative_differences(primary: DataFrame, reference: DataFrame) -> DataFrame:
    """Two results of ``moments`` -> (variable, metric, primary, reference, delta_pct); variables pair by trimmed lower-case name."""
    metrics = [m for m in primary.columns if m not in (*NOT_COMPARED, "variable", "group")]

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics]))
        return df.select(F.lower(F.trim("variable")).alias("variable"), pairs.alias("r")).select("variable", "r.*")

    out = long(primary, "primary").join(long(reference, "reference"), ["variable", "metric"])
    delta = F.try_divide(F.col("primary") - F.col("reference"), F.abs("reference")) * 100
    return out.withColumn("delta_pct", delta)


def bounding_box(df: DataFrame, axes: dict[str, str]) -> DataFrame:
    """(axis, min, max, extent) of finite coordinates."""
    stats = df.agg(*[F.struct(F.min(finite(F.col(c))).alias("min"), F.max(finite(F.col(c))).alias("max")).alias(f"__{i}") for i, c in enumerate(axes.values())])
    return _unfold(stats, [], list(axes)).select(F.col("variable").alias("axis"), "min", "max", (F.col("max") - F.col("min")).alias("extent"))


def column_overview(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(column, type, count, nulls, zeros, completeness, min, max, distinct) in one pass."""

    def stats(name: str, number: bool):
        v = value_of(name) if number else F.when(F.col(name) != "", F.col(name))
        none = F.lit(None).cast("double")
        return F.struct(
            F.lit("numeric" if number else "categorical").alias("type"), F.count(v).alias("count"), F.count_if(v.isNull()).alias("nulls"),
            (F.count_if(v == 0) if number else F.lit(None).cast("long")).alias("zeros"),
            (F.count(v) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("completeness"),
            (F.min(v) if number else none).alias("min"), (F.max(v) if number else none).alias("max"),
            (F.lit(None).cast("long") if number else F.count_distinct(v)).alias("distinct"),
        )

    columns = [(c, True) for c in numeric] + [(c, False) for c in categorical]
    wide = df.agg(*[stats(c, number).alias(f"__{i}") for i, (c, number) in enumerate(columns)])
    return _unfold(wide, [], [c for c, _ in columns]).withColumnRenamed("variable", "column")
