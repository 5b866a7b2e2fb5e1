"""Drillholes: validation, desurvey, compositing and interval merge of collar, survey and interval tables.

Every table is keyed by hole (``bhid``).  Work on one hole is windows within the hole; holes are spread over the cluster, and where
rows are looked up by depth or swept along it, a hole of very many rows is cut in ranges (``plans.sweep``).  A hole's survey stations are
few by nature.  Tables are dealt by hole over as many tasks as their rows need (``dealt``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..plans.dataset import Dataset
from ..plans.storage import dealt, spare_names
from ..plans.sweep import RANGE_ROWS, as_of, sized, swept

EPS = 1e-9
#: Dip beyond which a survey row is not usable.
MOST_DIP = 90.000001
BHIDS_PER_CHECK = 200
#: check -> what it reports
CHECKS = {
    "bad-collar": "collar rows without a hole id or finite coordinates, left out",
    "dup-collar": "collar rows after the first of a hole, left out",
    "orphan-survey": "survey rows of holes without a collar, left out",
    "orphan-interval": "interval rows of holes without a collar, left out",
    "bad-interval": "interval rows with a negative start or without length, left out",
    "collar-no-intervals": "holes without intervals, skipped",
    "bad-survey": "survey rows without finite depth, azimuth and dip, with a dip over 90 or a negative depth, left out",
    "dup-survey-depth": "survey rows at the depth of a later one, left out",
    "collar-no-survey": "holes without a usable survey row, taken as vertical",
    "past-eoh": "holes whose survey, or whose intervals, go beyond their end, kept",
    "overlap": "holes with overlapping intervals, kept",
}


def _hole(name: str = "bhid") -> Column:
    text = F.trim(F.col(name).cast("string"))
    return F.when(text != "", text).alias("bhid")


def first_collars(collars: DataFrame, order: str | None = None) -> DataFrame:
    """The first valid collar of every hole: (bhid, x, y, z, eoh).  ``order`` is a column of row numbers; without it, ties go by coordinates."""
    keys = [order] if order else ["x", "y", "z"]
    eoh = finite(F.col("eoh")) if "eoh" in collars.columns else F.lit(None).cast("double")
    rows = collars.select(_hole(), *[finite(F.col(c)).alias(c) for c in "xyz"], eoh.alias("eoh"), *([order] if order else [])).where("bhid is not null and x is not null and y is not null and z is not null")
    rows = dealt(rows, "bhid", rows=collars.count())
    return rows.withColumn("__p", F.row_number().over(Window.partitionBy("bhid").orderBy(*keys))).where("__p = 1").select("bhid", "x", "y", "z", "eoh")


def dip_convention(surveys: DataFrame) -> str:
    """``neg-down`` if the upper median of the non-zero dips is negative, else ``pos-down``."""
    dips = surveys.select(finite(F.col("dip")).alias("d")).where("d <> 0")
    row = dips.agg(F.expr("percentile_disc(0.5) within group (order by d desc)")).first()
    return "neg-down" if row[0] is not None and row[0] < 0 else "pos-down"


def _stations(surveys: DataFrame, convention: str, order: str | None) -> DataFrame:
    """(bhid, depth, az, dip, ok[, order]) of all survey rows, dips positive down; ok tells a usable row."""
    sign = -1.0 if convention == "neg-down" else 1.0
    rows = surveys.select(_hole(), finite(F.col("depth")).alias("depth"), finite(F.col("az")).alias("az"), (finite(F.col("dip")) * sign).alias("dip"), *([order] if order else []))
    return rows.withColumn("ok", F.coalesce((F.col("depth") >= 0) & F.col("az").isNotNull() & (F.abs("dip") <= MOST_DIP), F.lit(False)))


def _depth_order(order: str | None) -> list[str]:
    return ["depth", order] if order else ["depth", "az", "dip"]


def clean_surveys(surveys: DataFrame, collars: DataFrame, convention: str = "pos-down", order: str | None = None) -> DataFrame:
    """Stations (bhid, depth, az, dip, station) of known holes with dip positive down and one station at depth 0.

    Of stations within 1e-9 of depth the last stays, by ``order``, a column of row numbers, or else by azimuth and dip; a hole whose
    first station lies deeper gets one at 0 with the same attitude; a hole without stations hangs vertically.
    """
    rows = _stations(surveys, convention, order).where("bhid is not null and ok").drop("ok").withColumn("collar", F.lit(False))
    # A hole's collar stands above its stations and becomes the one at 0 where that is missing; holes and stations meet in one shuffle.
    above = collars.select("bhid", F.lit(float("-inf")).alias("depth"), F.lit(True).alias("collar"))
    line = dealt(rows.unionByName(above, allowMissingColumns=True), "bhid", rows=surveys.count() + collars.count())
    by = Window.partitionBy("bhid").orderBy(*_depth_order(order))
    line = line.withColumns({"next": F.lead("depth").over(by), "known": F.first("collar").over(by)})
    line = line.where(F.col("known") & (F.col("collar") | F.col("next").isNull() | (F.col("next") - F.col("depth") > EPS)))
    by = Window.partitionBy("bhid").orderBy("depth")
    line = line.withColumns({f"n_{c}": F.lead(c).over(by) for c in ("depth", "az", "dip")}).where(~F.col("collar") | F.col("n_depth").isNull() | (F.col("n_depth") > EPS))
    out = line.select("bhid", F.when(F.col("collar"), 0.0).otherwise(F.col("depth")).alias("depth"), *[F.when(F.col("collar"), F.coalesce(f"n_{c}", F.lit(d))).otherwise(F.col(c)).alias(c) for c, d in (("az", 0.0), ("dip", 90.0))])
    return out.withColumn("station", F.row_number().over(by))


def _tangent(az: Column, dip: Column) -> list[Column]:
    a, d = F.radians(az), F.radians(dip)
    return [F.sin(a) * F.cos(d), F.cos(a) * F.cos(d), -F.sin(d)]


def desurvey(stations: DataFrame, collars: DataFrame, method: str = "minimum-curvature") -> DataFrame:
    """Segments of each hole's path: (bhid, d0, d1, x, y, z at d0, tangents a and b at its ends, theta); the last one has d1 NULL.

    Positions are running sums of segment steps, each of which needs only its two stations.
    """
    t = stations.withColumns(dict(zip(("tx", "ty", "tz"), _tangent(F.col("az"), F.col("dip")))))
    by = Window.partitionBy("bhid").orderBy("depth")
    t = t.withColumns({f"n_{c}": F.lead(c).over(by) for c in ("depth", "tx", "ty", "tz")})
    dot = F.least(F.greatest(sum((F.col(c) * F.col(f"n_{c}") for c in ("ty", "tz")), F.col("tx") * F.col("n_tx")), F.lit(-1.0)), F.lit(1.0))
    t = t.withColumn("theta", F.acos(dot)).withColumn("dl", F.col("n_depth") - F.col("depth"))
    if method == "minimum-curvature":
        factor = F.when(F.col("theta") <= 1e-6, 1.0).otherwise(2.0 / F.col("theta") * F.tan(F.col("theta") / 2.0))
        step = lambda c: 0.5 * F.col("dl") * (F.col(c) + F.col(f"n_{c}")) * factor
    elif method == "balanced-tangential":
        step = lambda c: 0.5 * F.col("dl") * (F.col(c) + F.col(f"n_{c}"))
    elif method == "tangential":
        step = lambda c: F.col("dl") * F.col(f"n_{c}")
    else:
        raise ValueError(f"unknown method {method!r}")
    t = t.join(collars.select("bhid", *[F.col(c).alias(f"c_{c}") for c in "xyz"]), "bhid")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({f"s_{c}": step(f"t{c}") for c in "xyz"})
    t = t.withColumns({c: F.col(f"c_{c}") + F.coalesce(F.sum(f"s_{c}").over(before), F.lit(0.0)) for c in "xyz"})
    return t.select("bhid", F.col("depth").alias("d0"), F.col("n_depth").alias("d1"), "x", "y", "z", "tx", "ty", "tz", "n_tx", "n_ty", "n_tz", "theta", F.lit(method).alias("method"))


def positions(points: DataFrame, segments: DataFrame, depth: str = "depth", range_rows: int = RANGE_ROWS) -> DataFrame:
    """points(bhid, depth, ...) -> the same rows with px, py, pz on the hole's path.

    A point's segment is the last one that begins at or above it, found in one walk down the hole (``as_of``); above the first and below
    the last station the path runs straight on.  Points without a depth, and of holes without a path, are left out.
    """
    (seg,) = spare_names(points, "segment")
    first = F.row_number().over(Window.partitionBy("bhid").orderBy("d0")) == 1
    fields = F.struct(*[F.col(c) for c in segments.columns if c != "bhid"]).alias(seg)
    # The first segment begins above all points.
    marks = segments.select("bhid", F.when(first, F.lit(float("-inf"))).otherwise(F.col("d0")).alias(depth), fields)
    j = as_of(points, marks, "bhid", depth, seg, range_rows, few_marks=True)
    of = lambda c: F.col(f"{seg}.{c}")
    s, length, theta = F.col(depth) - of("d0"), of("d1") - of("d0"), of("theta")
    straight = of("d1").isNull() | (s <= 0)
    phi, k = theta * s / length, length / (theta * F.sin(theta))

    def at(axis: str) -> Column:
        p, t1, t2 = of(axis), of(f"t{axis}"), of(f"n_t{axis}")
        arc = F.when(theta < 1e-9, p + s * t1).otherwise(p + k * ((F.cos(theta - phi) - F.cos(theta)) * t1 + (1 - F.cos(phi)) * t2))
        chord = p + s * 0.5 * (t1 + t2)
        inner = F.when(of("method") == "minimum-curvature", arc).when(of("method") == "tangential", p + s * t2).otherwise(chord)
        return F.when(straight, p + s * t1).otherwise(inner)

    return j.select(*points.columns, at("x").alias("px"), at("y").alias("py"), at("z").alias("pz"))


def clean_intervals(intervals: DataFrame, collars: DataFrame) -> DataFrame:
    """Valid intervals of known holes; ``from`` and ``to`` become f and t, other columns stay."""
    others = [c for c in intervals.columns if c not in ("bhid", "from", "to")]
    rows = intervals.select(_hole(), finite(F.col("from")).alias("f"), finite(F.col("to")).alias("t"), *others)
    rows = dealt(rows.where("bhid is not null and f >= 0 and t > f"), "bhid", rows=intervals.count())
    return rows.join(collars.select("bhid"), "bhid", "left_semi")


def orphans(table: DataFrame, collars: DataFrame) -> DataFrame:
    """(bhid, n): rows of a survey or interval table by hole, of holes without a valid collar; rows without a hole id count under NULL."""
    rows = table.groupBy(_hole()).agg(F.count("*").alias("n"))
    return rows.join(first_collars(collars).select("bhid"), "bhid", "left_anti")


def validate(collars: DataFrame, surveys: DataFrame, intervals: DataFrame, convention: str = "pos-down", order: str | None = None) -> DataFrame:
    """(check_id, label, count, holes, bhids): what was left out or is worth knowing, with up to 200 holes per check.

    Every table is read once and dealt by hole once; what each has of a hole is counted there, and the checks are made from
    those counts, a row per hole.  Checks of surveys, of the hole's end and of overlaps look at holes with intervals only.
    """
    good = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull() & F.col("bhid").isNotNull()
    eoh = finite(F.col("eoh")) if "eoh" in collars.columns else F.lit(None).cast("double")
    c = collars.select(_hole(), *[finite(F.col(k)).alias(k) for k in "xyz"], eoh.alias("eoh"), *([order] if order else []))
    first = F.struct(*([order] if order else ["x", "y", "z"]))
    c = c.groupBy("bhid").agg(F.count_if(good).alias("collars"), F.count_if(~good).alias("bad"), F.min_by(F.struct("eoh"), F.when(good, first))["eoh"].alias("eoh"))
    s = _stations(surveys, convention, order).withColumn("next", F.lead("depth").over(Window.partitionBy("bhid", "ok").orderBy(*_depth_order(order))))
    s = s.groupBy("bhid").agg(F.count("*").alias("surveys"), F.count_if("ok").alias("stations"), F.count_if(F.col("ok") & (F.col("next") - F.col("depth") <= EPS)).alias("twice"), F.max(F.when(F.col("ok"), F.col("depth"))).alias("deepest"))
    i = intervals.select(_hole(), finite(F.col("from")).alias("f"), finite(F.col("to")).alias("t")).withColumn("ok", F.coalesce((F.col("f") >= 0) & (F.col("t") > F.col("f")), F.lit(False)))
    i = i.withColumn("above", F.lag("t").over(Window.partitionBy("bhid", "ok").orderBy("f", "t")))
    i = i.groupBy("bhid").agg(F.count("*").alias("intervals"), F.count_if("ok").alias("usable"), F.count_if(F.col("ok") & (F.col("f") < F.col("above") - EPS)).alias("over"), F.max(F.when(F.col("ok"), F.col("t"))).alias("end"))
    # Rows without a hole id keep a row of their own from each table; they are never equal to each other.
    rows = c.join(s, "bhid", "full_outer").join(i, "bhid", "full_outer")
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    known, has = n("collars") > 0, n("usable") > 0
    one = lambda cond: F.coalesce(cond, F.lit(False)).cast("long")
    ready = known & has
    found = {
        "bad-collar": n("bad"),
        "dup-collar": F.greatest(n("collars") - 1, F.lit(0)),
        "orphan-survey": F.when(~known, n("surveys")).otherwise(0),
        "orphan-interval": F.when(~known, n("intervals")).otherwise(0),
        "bad-interval": F.when(known, n("intervals") - n("usable")).otherwise(0),
        "collar-no-intervals": one(known & ~has),
        "bad-survey": F.when(ready, n("surveys") - n("stations")).otherwise(0),
        "dup-survey-depth": F.when(ready, n("twice")).otherwise(0),
        "collar-no-survey": one(ready & (n("stations") == 0)),
        "past-eoh": F.when(ready, one(F.col("deepest") > F.col("eoh") + EPS) + one(F.col("end") > F.col("eoh") + EPS)).otherwise(0),
        "overlap": one(ready & (n("over") > 0)),
    }
    hits = rows.select("bhid", F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), v.cast("long").alias("n")) for k, v in found.items()])).alias("h")).select("bhid", "h.*").where("n > 0")
    totals = hits.groupBy("check_id").agg(F.sum("n").alias("count"), F.count("bhid").alias("holes"))
    # Ranks beyond the limit are dropped before the shuffle, so a check with many holes is not sorted in one task.
    some = hits.where("bhid is not null").withColumn("place", F.row_number().over(Window.partitionBy("check_id").orderBy("bhid"))).where(F.col("place") <= BHIDS_PER_CHECK)
    some = some.groupBy("check_id").agg(F.sort_array(F.collect_list("bhid")).alias("bhids"))
    labels = F.create_map(*[F.lit(x) for pair in CHECKS.items() for x in pair])
    out = totals.join(F.broadcast(some), "check_id", "left")  # a row per check
    return out.select("check_id", labels[F.col("check_id")].alias("label"), "count", "holes", F.coalesce("bhids", F.array().cast("array<string>")).alias("bhids"))


def default_length(intervals: DataFrame) -> DataFrame:
    """(length): the commonest interval length to 0.01, the shorter of equals; 1 without intervals."""
    lengths = intervals.select(F.round(finite(F.col("to")) - finite(F.col("from")), 2).alias("length")).where("length > 0")
    best = lengths.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(1)
    return best.agg(F.coalesce(F.max("length"), F.lit(1.0)).alias("length"))


def composite(intervals: DataFrame, length: float, numeric: dict[str, str], categories: dict[str, str] | None = None, split: tuple[str, ...] = (), density: str | None = None, min_coverage: float = 0.0, by_hole: bool = False) -> DataFrame:
    """Clean intervals(bhid, f, t, ...) -> (bhid, run, window, from, to, support, mid, columns..., mixed).

    numeric: column -> mean, sum, min or max; categories: column -> majority or first.  Runs start anew where the split columns
    change; a run is cut in windows of ``length`` from its top.  Each interval meets only the windows that it touches.
    A mean weighs by covered length, times density if given (missing or not above zero: weight 0).  ``mid`` is the centroid
    of the covered lengths.  Windows covered by less than ``min_coverage`` of their length are dropped.  ``by_hole`` tells that the table is
    dealt by hole already, which spares counting and dealing it.
    """
    categories = categories or {}
    by = Window.partitionBy("bhid").orderBy("f", "t")
    rows = intervals if by_hole else dealt(intervals, "bhid")
    if split:
        key = F.struct(*[F.col(c) for c in split])
        rows = rows.withColumn("__key", key).withColumn("__new", F.coalesce((~F.col("__key").eqNullSafe(F.lag("__key").over(by))).cast("int"), F.lit(1)))
        rows = rows.withColumn("run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        rows = rows.withColumn("run", F.lit(1).cast("long"))
    run = Window.partitionBy("bhid", "run")
    rows = rows.withColumn("__a", F.min("f").over(run)).withColumn("__z", F.max("t").over(run))
    last = F.greatest(F.ceil((F.col("__z") - F.col("__a") - EPS) / length) - 1, F.lit(0))
    touched = F.sequence(F.least(F.floor((F.col("f") - F.col("__a")) / length), last), F.least(F.floor((F.col("t") - F.col("__a")) / length), last))
    rows = rows.withColumn("window", F.explode(touched))
    rows = rows.withColumn("w0", F.col("__a") + F.col("window") * length).withColumn("w1", F.least(F.col("w0") + length, F.col("__z")))
    rows = rows.withColumn("lo", F.greatest("f", "w0")).withColumn("hi", F.least("t", "w1")).withColumn("len", F.col("hi") - F.col("lo")).where("len > 1e-12")
    keys = ["bhid", "run", "window", "w0", "w1"]
    heavy = F.when(finite(F.col(density)) > 0, finite(F.col(density))).otherwise(0.0) if density else F.lit(1.0)
    aggs = [F.sum("len").alias("support"), (F.sum(F.col("len") * (F.col("lo") + F.col("hi")) / 2) / F.sum("len")).alias("mid")]
    for c, rule in numeric.items():
        v = finite(F.col(c))
        w = F.when(v.isNotNull(), F.col("len") * (F.lit(1.0) if c == density else heavy))
        aggs.append({"mean": F.try_divide(F.sum(v * w), F.sum(w)), "sum": F.sum(v * F.col("len")), "min": F.min(v), "max": F.max(v)}[rule].alias(c))
    if density:
        aggs.append(F.count_if(finite(F.col(density)).isNull() | (finite(F.col(density)) <= 0)).alias("missing_density"))
    for c, rule in categories.items():
        if rule == "first":
            aggs.append(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("lo", "t"))).alias(c))
    out = rows.groupBy(*keys).agg(*aggs)
    mixed = F.lit(False)
    for c, rule in categories.items():
        if rule != "majority":
            continue
        shares = rows.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.sum("len").alias("n"), F.min("lo").alias("top"))
        # The longest share wins; of equals the one that starts higher up, then the smaller value.
        best = shares.groupBy(*keys).agg(F.min_by(c, F.struct(-F.col("n"), "top", c)).alias(c), (F.count("*") > 1).alias(f"__m_{c}"))
        out = out.join(best, keys, "left")
        mixed = mixed | F.coalesce(F.col(f"__m_{c}"), F.lit(False))
    out = out.where(F.col("support") / (F.col("w1") - F.col("w0")) >= min_coverage)
    extra = ["missing_density"] if density else []
    return out.select("bhid", "run", "window", F.col("w0").alias("from"), F.col("w1").alias("to"), "support", "mid", *numeric, *categories, *extra, mixed.alias("mixed"))


def process(collars: DataFrame, surveys: DataFrame, intervals: DataFrame, length: float | None, numeric: dict[str, str], method: str = "minimum-curvature", convention: str | None = None, order: str | None = None, **rules) -> tuple[DataFrame, DataFrame]:
    """Validate, desurvey and composite: (composites with px, py, pz; report).

    Without a length, ``default_length`` is taken, and without a convention ``dip_convention``; each reads one small result.
    ``order`` names the column of row numbers by which the first collar and the last of equal stations are told.
    """
    convention = convention or dip_convention(surveys)
    length = length or default_length(intervals).first()["length"]
    known = first_collars(collars, order)
    path = desurvey(clean_surveys(surveys, known, convention, order), known, method)
    parts = composite(clean_intervals(intervals, known), length, numeric, by_hole=True, **rules)
    return positions(parts, path, "mid"), validate(collars, surveys, intervals, convention, order)


def desurvey_intervals(collars: DataFrame, surveys: DataFrame, intervals: DataFrame, method: str = "minimum-curvature", convention: str = "pos-down", order: str | None = None) -> DataFrame:
    """Every valid interval with its length and the position of its mid-point."""
    known = first_collars(collars, order)
    path = desurvey(clean_surveys(surveys, known, convention, order), known, method)
    rows = clean_intervals(intervals, known).withColumn("length", F.col("t") - F.col("f")).withColumn("mid", (F.col("f") + F.col("t")) / 2)
    return positions(rows, path, "mid")


#: What can be made of a set of drillhole tables, and the column by which its rows are weighed.
EMITTED = {"collar": None, "composite": "support", "intervals": "length"}


def emit(role: str, collars: DataFrame, surveys: DataFrame, intervals: DataFrame, **options) -> Dataset:
    """A set of drillhole tables as a point dataset with coordinates x, y, z: collars, composites or desurveyed intervals.

    options are those of ``first_collars``, ``process`` or ``desurvey_intervals``.  Composites are weighed by what they cover,
    intervals by their length.
    """
    if role not in EMITTED:
        raise ValueError(f"unknown role {role!r}")
    if role == "collar":
        return Dataset(first_collars(collars, **options))
    if role == "composite":
        rows = process(collars, surveys, intervals, **options)[0]
    else:
        rows = desurvey_intervals(collars, surveys, intervals, **options).withColumnsRenamed({"f": "from", "t": "to"})
    return Dataset(rows.withColumnsRenamed({"px": "x", "py": "y", "pz": "z"}), weight=EMITTED[role])


def prepared(table: DataFrame, calculated: dict[str, Column | str] | None = None, where: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """One drillhole table with calculated columns behind its own and a filter: (rows, counts(total, kept))."""
    d = Dataset(table, calculated or {}, where)
    return d.frame(), d.filter_count()


def length_histogram(lengths: DataFrame, column: str, n_bins: int = 14) -> DataFrame:
    """(bin, low, high, n) of equal bins between least and largest length."""
    rows = lengths.select(finite(F.col(column)).alias("v")).where("v is not null")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    low, high = (0.0, 1.0) if low is None else (low, high)
    step = (high - low) / n_bins or 1.0
    at = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(step)), F.lit(n_bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(low) + F.col("bin") * step).alias("low"), (F.lit(low) + (F.col("bin") + 1) * step).alias("high"), "n")


def merge(a: DataFrame, b: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``merge_all`` of two interval tables."""
    return merge_all([a, b], order)


def merge_all(tables: list[DataFrame], order: str | None = None, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Interval tables(bhid, from, to, ...) on their common break points: (segments, report(check_id, count)).

    Break points closer than 1e-9 are one.  A segment takes the first interval of each table that covers its mid-point, by start
    and then by ``order``, a column of row numbers, or else by end and values; where none covers it is dropped.  Columns that clash with
    one of an earlier table get the suffix _2, _3 ... of their table and are counted as column-collision.  In the report tables are a, b, c ...:
    segments of a table's own holes that it does not cover (gap-a) or covers more than once (overlap-a), and holes that it alone has (hole-only-a).

    All tables are swept at once: starts and ends lie in one line down the hole, and each table's covering interval and number of open intervals
    are carried along it, so no segment is joined with intervals, however many tables there are.
    """
    own = ("bhid", "from", "to", *([order] if order else []))
    numbers, rows = range(len(tables)), None
    for k, df in enumerate(tables):
        others = [F.col(f"`{c}`") for c in df.columns if c not in own]
        part = df.select(_hole(), finite(F.col("from")).alias("f"), finite(F.col("to")).alias("t"), F.lit(k).alias("no"), F.struct(*others or [F.lit(None).cast("string").alias("_")]).alias(f"p{k}"), *([F.col(order).alias("at")] if order else []))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rows = rows.where("bhid is not null and t > f")
    n, cuts = sized(rows.select("bhid", "f"), "bhid", "f", range_rows)
    # One shuffle by hole serves all windows below; holes that are cut need one for each line.
    rows = dealt(rows, "bhid", rows=n) if cuts is None else rows
    ties = ["at"] if order else ["t", *[f"p{k}" for k in numbers]]
    rows = swept(rows, ["bhid", "no"], ["f", *ties], topped=("t",), cuts=cuts)
    # Earlier starts come first, so an interval is the one to take from where all earlier ones have ended.
    start = F.greatest("f", "t_before")
    here = F.when(F.col("t") > start, start)
    event = lambda d, step, shows: F.struct(d.alias("d"), F.lit(step).cast("long").alias("step"), shows.alias("shows"))
    later = F.when(here > F.col("f"), F.array(event(here, 0, F.lit(True)))).otherwise(F.array().cast("array<struct<d:double,step:bigint,shows:boolean>>"))
    both = F.array(event(F.col("f"), 1, F.coalesce(here == F.col("f"), F.lit(False))), event(F.col("t"), -1, F.lit(False)))
    line = rows.withColumn("e", F.explode(F.concat(both, later)))
    taken = [F.when(F.col("e.shows") & (F.col("no") == k), F.struct("t", f"p{k}")).alias(f"s{k}") for k in numbers]
    line = line.select("bhid", "e.d", *taken, *[F.when(F.col("no") == k, F.col("e.step")).otherwise(0).alias(f"n{k}") for k in numbers])
    line = swept(line, ["bhid"], ["d"], topped=("d",), cuts=cuts)
    line = line.withColumn("from", F.when(F.col("d_before").isNull() | (F.col("d") - F.col("d_before") > EPS), F.col("d"))).drop("d_before")
    line = swept(line, ["bhid"], ["d"], held=("from", *[f"s{k}" for k in numbers]), summed=tuple(f"n{k}" for k in numbers), following="to", cuts=cuts)
    # The last event of those that count as one break point has seen all of them.
    line = line.where(F.col("to") - F.col("d") > EPS)
    mid = (F.col("from") + F.col("to")) / 2
    covers = [F.when(F.col(f"s{k}.t") >= mid, F.col(f"s{k}.p{k}")).alias(f"p{k}") for k in numbers]
    out = line.select("bhid", "from", "to", *covers, *[f"n{k}" for k in numbers]).where(_any([F.col(f"p{k}").isNotNull() for k in numbers]))

    names: list[list[tuple[str, str]]] = []
    taken_names = set(own)
    for k, df in enumerate(tables):
        names.append([])
        for c in (c for c in df.columns if c not in own):
            tries = (n for n in (c, f"{c}_{k + 1}", *(f"{c}_{k + 1}{i}" for i in range(2, sum(len(t.columns) for t in tables) + 3))))
            name = next(n for n in tries if n not in taken_names)
            taken_names.add(name)
            names[k].append((c, name))
    segments = out.select("bhid", "from", "to", *[F.col(f"p{k}.`{c}`").alias(n) for k in numbers for c, n in names[k]])
    return segments, _merge_report(rows, out, len(tables), sum(c != n for own_names in names for c, n in own_names))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _merge_report(rows: DataFrame, segments: DataFrame, tables: int, collisions: int) -> DataFrame:
    """(check_id, count) of a merge, from one row per hole."""
    tags = [chr(97 + k) if k < 26 else str(k + 1) for k in range(tables)]
    holes = rows.groupBy("bhid").agg(*[F.bool_or(F.col("no") == k).alias(f"has{k}") for k in range(tables)])
    counts = segments.groupBy("bhid").agg(*[F.count_if(F.col(f"p{k}").isNull()).alias(f"gap{k}") for k in range(tables)], *[F.count_if(F.col(f"n{k}") > 1).alias(f"over{k}") for k in range(tables)])
    each = holes.join(counts, "bhid", "left")
    several = sum((F.col(f"has{k}").cast("int") for k in range(1, tables)), F.col("has0").cast("int"))
    found: dict[str, Column] = {}
    for k, tag in enumerate(tags):
        found[f"gap-{tag}"] = F.sum(F.when(F.col(f"has{k}"), F.col(f"gap{k}")))
        found[f"overlap-{tag}"] = F.sum(f"over{k}")
        found[f"hole-only-{tag}"] = F.count_if(F.col(f"has{k}") & (several == 1))
    wide = each.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in found.items()], F.lit(collisions).cast("long").alias("column-collision"))
    checks = [*found, "column-collision"]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_id"), F.col(f"`{n}`").alias("count")) for n in checks])).alias("r")).select("r.*")


# Header names by which the roles of drillhole columns are recognised, most telling first, and words in file names.
ROLE_NAMES = {
    "bhid": ("bhid", "holeid", "hole_id", "dhid", "hole", "dhno", "name", "id", "furo"),
    "x": ("x", "east", "easting", "xcollar", "x_collar", "xc"),
    "y": ("y", "north", "northing", "ycollar", "y_collar", "yc"),
    "z": ("z", "elev", "elevation", "rl", "zcollar", "z_collar", "zc", "cota"),
    "eoh": ("eoh", "depth", "maxdepth", "td", "total_depth", "totaldepth", "max_depth", "length"),
    "depth": ("at", "depth", "dist", "distance", "md"),
    "az": ("az", "azim", "azimuth", "brg", "bearing", "azi", "azimute"),
    "dip": ("dip", "incl", "inclination", "plunge"),
    "from": ("from", "depfrom", "from_m", "depth_from", "de"),
    "to": ("to", "depto", "to_m", "depth_to", "ate"),
}
FILE_WORDS = {"intervals": ("assay", "sample", "interval", "lith"), "survey": ("survey", "desv"), "collar": ("collar", "colar")}
#: Roles that a table needs and those it may have besides, the most telling kind of table first.
TABLES = {"intervals": (("bhid", "from", "to"), ()), "survey": (("bhid", "az", "dip"), ("depth",)), "collar": (("bhid", "x", "y", "z"), ("eoh",))}
#: Least share of numbers among a column's values that makes it numeric.
NUMERIC_SHARE = 0.7


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def map_columns(columns: list[str], kind: str | None = None) -> dict[str, str]:
    """role -> column by known header names, whatever their case and punctuation; of a kind of table, or of all roles."""
    held: dict[str, str] = {}
    for c in columns:
        held.setdefault(_plain(c), c)
    roles = [r for part in TABLES[kind] for r in part] if kind else list(ROLE_NAMES)
    hits = {r: next((held[_plain(n)] for n in ROLE_NAMES[r] if _plain(n) in held), None) for r in roles}
    return {r: c for r, c in hits.items() if c is not None}


def table_role(columns: list[str], file: str = "") -> str | None:
    """What a table with these columns is: intervals, survey, collar or nothing known; the file's name decides where columns do not."""
    for kind, (needed, _) in TABLES.items():
        if set(needed) <= map_columns(columns, kind).keys():
            return kind
    return next((kind for kind, words in FILE_WORDS.items() if any(w in _plain(file) for w in words)), None)


def renamed(df: DataFrame, kind: str | None = None) -> DataFrame:
    """The table with the roles of its kind as column names; without a kind, ``table_role`` tells it."""
    kind = kind or table_role(df.columns)
    return df.withColumnsRenamed({c: role for role, c in map_columns(df.columns, kind).items() if c != role})


def typed_columns(df: DataFrame) -> DataFrame:
    """Text columns of an interval table as doubles where at least 70 % of their values, over all rows, are numbers."""
    others = [c for c, kind in df.dtypes if kind == "string" and c not in ("bhid", "from", "to")]
    if not others:
        return df
    texts = {c: F.trim(F.col(c)) for c in others}
    shares = df.agg(*[F.try_divide(F.count_if((t != "") & t.try_cast("double").isNotNull()), F.count_if(t != "")).alias(f"s{k}") for k, t in enumerate(texts.values())]).first()
    return df.withColumns({c: finite(t.try_cast("double")) for k, (c, t) in enumerate(texts.items()) if (shares[f"s{k}"] or 0) >= NUMERIC_SHARE})


def collar_points(collars: DataFrame, order: str | None = None) -> DataFrame:
    """Valid collars as a point dataset."""
    return first_collars(collars, order)
