"""Grade-tonnage curves, binned and exact, and their affine change of support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..plans.levels import levels_passed
from .statistics import group_key, valid_weight, value_of

BINS = 10_000


def tonnage(dims: tuple[str, str, str] | None = None, block_volume: float | None = None, density: str | float | None = None, weight: str | float | None = None) -> tuple[Column, Column]:
    """(tonnes of a row, reason why it has none): volume times density times weight.

    Volume is |dx dy dz| of the size columns, else the block's volume, else 1.  Density and weight are a constant above
    zero, or a column that must be finite and above zero, or 1.  The first failing check in this order gives the reason.
    """
    if dims:
        volume = F.abs(finite(F.col(dims[0])) * finite(F.col(dims[1])) * finite(F.col(dims[2])))
    else:
        volume = F.lit(float(block_volume) if block_volume and block_volume > 0 else 1.0)

    def factor(x) -> Column:
        if isinstance(x, str):
            v = finite(F.col(x))
            return F.when(v > 0, v)
        return F.lit(float(x) if x and x > 0 else 1.0)

    d, w = factor(density), factor(weight)
    reason = F.when(volume.isNull(), "volume").when(d.isNull(), "density").when(w.isNull(), "weight")
    return volume * d * w, reason


def exclusions(df: DataFrame, **spec) -> DataFrame:
    """(reason, n) of rows that give no tonnage."""
    _, reason = tonnage(**spec)
    return df.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def grade_range(df: DataFrame, grade: str) -> tuple[float, float]:
    """Least and largest grade, widened by a thousandth of their range (of 1 where they are equal)."""
    low, high = df.agg(F.min(value_of(grade)), F.max(value_of(grade))).first()
    if low is None:
        return 0.0, 1.0
    pad = 0.001 * (high - low if high > low else 1.0)
    return low - pad, high + pad


def bins(df: DataFrame, grades: dict[str, tuple[float, float]], group: str | None = None, n_bins: int = BINS, **spec) -> DataFrame:
    """(variable, [group,] bin, low, step, t, gt): tonnes and grade times tonnes per bin of every grade, all in one pass."""
    tonnes, _ = tonnage(**spec)

    def cell(name: str, low: float, high: float) -> Column:
        step = (high - low) / n_bins
        g = value_of(name)
        at = F.greatest(F.least(F.floor((g - F.lit(low)) / F.lit(step)), F.lit(n_bins - 1)), F.lit(0))
        return F.struct(F.lit(name).alias("variable"), at.cast("int").alias("bin"), F.lit(float(low)).alias("low"), F.lit(float(step)).alias("step"), g.alias("g"))

    keys = ["group"] if group else []
    rows = df.select(*([group_key(group).alias("group")] if group else []), tonnes.alias("t"), F.explode(F.array(*[cell(k, *v) for k, v in grades.items()])).alias("c"))
    rows = rows.where("t is not null and c.g is not null")
    return rows.groupBy("c.variable", *keys, "c.bin", "c.low", "c.step").agg(F.sum("t").alias("t"), F.sum(F.col("c.g") * F.col("t")).alias("gt"))


GROUPS = 200


def bin_curve(binned: DataFrame, n_bins: int = BINS, groups: int = GROUPS) -> DataFrame:
    """(variable, [group,] bin, cutoff, tonnage, grade, metal[, overflow]) at the lower edge of every one of the bins, empty ones included.

    Tonnage and metal are those of the bin and all above it.  Of groups the ``groups`` with most tonnes are listed (ties: the smaller
    name) and overflow tells that there are more; a curve without groups is of all rows.
    """
    keys = [c for c in binned.columns if c in ("variable", "group")]
    heads = binned.groupBy(*keys).agg(F.first("low").alias("low"), F.first("step").alias("step"), F.sum("t").alias("of"))
    if "group" in keys:
        by = Window.partitionBy("variable").orderBy(F.desc("of"), "group")
        heads = heads.withColumn("place", F.row_number().over(by)).where(F.col("place") <= groups + 1)
        heads = heads.withColumn("overflow", F.max("place").over(Window.partitionBy("variable")) > groups).where(F.col("place") <= groups)
    dense = heads.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    rows = dense.join(binned.select(*keys, "bin", "t", "gt"), [*keys, "bin"], "left")
    above = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # ``n_bins`` rows
    t, m = F.sum(F.coalesce("t", F.lit(0.0))).over(above), F.sum(F.coalesce("gt", F.lit(0.0))).over(above)
    rows = rows.withColumn("tonnage", t).withColumn("metal", m)
    flag = ["overflow"] if "group" in keys else []
    return rows.select(*keys, "bin", (F.col("low") + F.col("bin") * F.col("step")).alias("cutoff"), "tonnage", F.when(F.col("tonnage") > 0, F.col("metal") / F.col("tonnage")).otherwise(0.0).alias("grade"), "metal", *flag)


def at_cutoffs(binned: DataFrame, cutoffs: list[float], n_bins: int = BINS, grade_factor: float = 1.0, tonnage_divisor: float = 1.0, metal_divisor: float = 1.0) -> DataFrame:
    """(variable, [group,] cutoff, tonnage, grade, metal, pct, grade_exact) at user cutoffs, from the bins alone.

    Tonnage, grade and metal are interpolated between the bins' lower edges each for itself, so grade is not exactly metal
    over tonnage there; grade_exact is.  pct is the share of all tonnes of the variable (and group).
    """
    keys = [c for c in binned.columns if c in ("variable", "group")]
    rows = binned.withColumn("cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])))
    at = F.greatest(F.least((F.col("cutoff") - F.col("low")) / F.col("step"), F.lit(n_bins - 1.0)), F.lit(0.0))
    rows = rows.withColumn("i", F.floor(at)).withColumn("frac", at - F.floor(at)).withColumn("j", F.least(F.col("i") + 1, F.lit(n_bins - 1)))

    def above(edge: str, amount: str) -> Column:
        return F.sum(F.when(F.col("bin") >= F.col(edge), F.col(amount)).otherwise(0.0))

    sums = rows.groupBy(*keys, "cutoff", "frac").agg(above("i", "t").alias("t0"), above("j", "t").alias("t1"), above("i", "gt").alias("m0"), above("j", "gt").alias("m1"), F.sum("t").alias("all"))
    grade = lambda m, t: F.when(F.col(t) > 0, F.col(m) / F.col(t)).otherwise(0.0)
    mixed = lambda a, b: a + (b - a) * F.col("frac")
    t, m = mixed(F.col("t0"), F.col("t1")), mixed(F.col("m0"), F.col("m1"))
    return sums.select(
        *keys, "cutoff", (t / tonnage_divisor).alias("tonnage"), mixed(grade("m0", "t0"), grade("m1", "t1")).alias("grade"), (m * grade_factor / metal_divisor).alias("metal"),
        F.try_divide(t * 100, F.col("all")).alias("pct"), F.when(t > 0, m / t).otherwise(0.0).alias("grade_exact"),
    )


def exact(df: DataFrame, grade: str, cutoffs: list[float], group: str | None = None, **spec) -> DataFrame:
    """([group,] cutoff, tonnage, grade, metal) of rows with a grade of the cutoff or more, without bins.

    Rows are first summed by how many cutoffs they reach, so their number does not multiply by the cutoffs.
    """
    tonnes, _ = tonnage(**spec)
    keys = ["group"] if group else []
    cutoffs = sorted(float(c) for c in cutoffs)
    levels = F.array(*[F.lit(c) for c in cutoffs])
    rows = df.select(*([group_key(group).alias("group")] if group else []), tonnes.alias("t"), value_of(grade).alias("g")).where("t is not null and g is not null")
    sums = rows.withColumn("reached", levels_passed(cutoffs, lambda c: c <= F.col("g"))).groupBy(*keys, "reached").agg(F.sum("t").alias("t"), F.sum(F.col("g") * F.col("t")).alias("m"))
    out = sums.select(*keys, "reached", "t", "m", F.posexplode(levels).alias("i", "cutoff"))
    here = F.col("reached") > F.col("i")
    out = out.groupBy(*keys, "cutoff").agg(F.sum(F.when(here, F.col("t")).otherwise(0.0)).alias("tonnage"), F.sum(F.when(here, F.col("m")).otherwise(0.0)).alias("metal"))
    return out.withColumn("grade", F.when(F.col("tonnage") > 0, F.col("metal") / F.col("tonnage")).otherwise(0.0))


def theoretical(samples: DataFrame, variable: str, cutoffs: list[float], f: float = 0.6, weight: str | None = None) -> DataFrame:
    """(cutoff, t_frac, grade): sample curve after an affine change of support with variance factor ``f`` in (0, 1]."""
    rows = samples.select(value_of(variable).alias("v"), valid_weight(weight).alias("w")).where("v is not null and w is not null")
    total, mean = rows.agg(F.sum("w"), F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w"))).first()
    if total is None:
        return samples.sparkSession.createDataFrame([(float(c), 0.0, 0.0) for c in cutoffs], "cutoff double, t_frac double, grade double")
    cutoffs = sorted(float(c) for c in cutoffs)
    levels = F.array(*[F.struct(F.lit(c).alias("cutoff")) for c in cutoffs])
    shrunk = [mean + (c - mean) / max(f, 1e-6) ** 0.5 for c in cutoffs]
    sums = rows.withColumn("over", levels_passed(shrunk, lambda x: x < F.col("v"))).groupBy("over").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("wv"))
    out = sums.select("over", "w", "wv", F.posexplode(levels).alias("i", "l"))
    here = F.col("over") > F.col("i")
    out = out.groupBy("l.cutoff").agg(F.sum(F.when(here, F.col("w")).otherwise(0.0)).alias("w"), F.sum(F.when(here, F.col("wv")).otherwise(0.0)).alias("wv"))
    grade = F.when(F.col("w") > 0, F.lit(mean) + F.lit(f**0.5) * (F.col("wv") / F.col("w") - F.lit(mean))).otherwise(0.0)
    return out.select("cutoff", (F.col("w") / F.lit(total)).alias("t_frac"), grade.alias("grade"))


def cutoff_range(low: float, high: float, step: float) -> list[float]:
    """Cutoffs from low to high, the end included within a thousandth of a step, to 10 significant digits."""
    if step <= 0:
        raise ValueError("the step must be above zero")
    count = int((high - low) / step + 0.001)
    return [float(f"{low + k * step:.10g}") for k in range(count + 1)]
