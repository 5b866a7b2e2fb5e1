"""Queries over drillholes: orders as collars, lines of an order as its intervals, three survey stations per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drillhole
from ..plans.storage import dealt
from .registry import query, rounded, table


def collars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("bhid"), F.col("o_custkey").cast("double").alias("x"), F.month("o_orderdate").cast("double").alias("y"), F.day("o_orderdate").cast("double").alias("z"), F.lit(5.0).alias("eoh"))


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return o.select(F.col("o_orderkey").cast("string").alias("bhid"), (F.col("s") * 3).cast("double").alias("depth"), (F.dayofyear("o_orderdate") + 10 * F.col("s")).cast("double").alias("az"), (60 + F.month("o_orderdate") + 2 * F.col("s")).cast("double").alias("dip"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("bhid"), (F.col("l_linenumber") - 1).cast("double").alias("from"), F.col("l_linenumber").cast("double").alias("to"), "l_discount", "l_quantity", "l_extendedprice", "l_returnflag")


_C = "c as (select cast(o_orderkey as varchar) bhid, cast(o_custkey as double) x, cast(month(o_orderdate) as double) y, cast(day(o_orderdate) as double) z from orders)"
_S = "s as (select cast(o_orderkey as varchar) bhid, cast(s * 3 as double) depth, cast(dayofyear(o_orderdate) + 10 * s as double) az, cast(60 + month(o_orderdate) + 2 * s as double) dip from orders, (select unnest([0, 1, 2]) s))"
_I = "i as (select cast(l_orderkey as varchar) bhid, cast(l_linenumber - 1 as double) f, cast(l_linenumber as double) t, l_discount, l_quantity, l_extendedprice, l_returnflag from lineitem)"
_T = "t as (select *, sin(radians(az)) * cos(radians(dip)) tx, cos(radians(az)) * cos(radians(dip)) ty, -sin(radians(dip)) tz from s)"
_N = "n as (select *, lead(depth) over w nd, lead(tx) over w nx, lead(ty) over w ny, lead(tz) over w nz from t window w as (partition by bhid order by depth))"
_A = "a as (select *, nd - depth dl, acos(least(greatest(tx * nx + ty * ny + tz * nz, -1.0), 1.0)) theta from n)"
_P = """p as (select a.bhid, a.depth d0, nd d1, theta, tx, ty, tz, nx, ny, nz, c.x + coalesce(sum(0.5 * dl * (tx + nx) * rf) over w, 0) x, c.y + coalesce(sum(0.5 * dl * (ty + ny) * rf) over w, 0) y, c.z + coalesce(sum(0.5 * dl * (tz + nz) * rf) over w, 0) z
    from (select *, case when theta <= 1e-6 then 1.0 else 2.0 / theta * tan(theta / 2.0) end rf from a) a join c on a.bhid = c.bhid window w as (partition by a.bhid order by a.depth rows between unbounded preceding and 1 preceding))"""
_PATH = ", ".join((_C, _S, _T, _N, _A, _P))


def _at(axis: str, depth: str) -> str:
    s = f"({depth} - d0)"
    arc = f"{axis} + (d1 - d0) / (theta * sin(theta)) * ((cos(theta - theta * {s} / (d1 - d0)) - cos(theta)) * t{axis} + (1 - cos(theta * {s} / (d1 - d0))) * n{axis})"
    return f"round(case when d1 is null or {s} <= 0 or theta < 1e-9 then {axis} + {s} * t{axis} else {arc} end, 6)"


def _path(spark: SparkSession, sf_dir: str, method: str = "minimum-curvature") -> DataFrame:
    known = drillhole.first_collars(collars(spark, sf_dir))
    return drillhole.desurvey(drillhole.clean_surveys(surveys(spark, sf_dir), known), known, method)


@query(f"""with {_I}, {_S}, o as (select cast(o_orderkey as varchar) bhid from orders where o_orderstatus <> 'P'), k as (select i.* from i semi join o on i.bhid = o.bhid), d as (select *, lag(t) over (partition by bhid order by f, t) above from k), r as (select distinct bhid from k),
    h as (select 'orphan-interval' as check_id, bhid, count(*) n from (select * from i anti join o on i.bhid = o.bhid) group by 2 union all select 'orphan-survey', cast(o_orderkey as varchar), 3 from orders where o_orderstatus = 'P'
        union all select 'past-eoh', bhid, 1 from r union all select 'past-eoh', bhid, 1 from k where t > 5 group by 2 union all select 'overlap', bhid, 1 from d where f < above - 1e-9 group by 2
        union all select 'collar-no-intervals', bhid, 1 from (select * from o anti join i on i.bhid = o.bhid)),
    u as (select distinct check_id, bhid from h), l as (select *, row_number() over (partition by check_id order by bhid) p from u)
    select h.check_id, cast(sum(n) as bigint) as "count", count(distinct bhid) as holes, any_value(ids) as bhids from h join (select check_id, string_agg(bhid, ' ' order by bhid) ids from l where p <= 200 group by 1) x on h.check_id = x.check_id group by 1""")
def dh_validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hole's survey reaches 6, beyond its end at 5; three orders of four statuses are collars."""
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("bhid"))
    report = drillhole.validate(collars(spark, sf_dir).join(known, "bhid", "left_semi"), surveys(spark, sf_dir), intervals(spark, sf_dir))
    return report.select("check_id", "count", "holes", F.array_join("bhids", " ").alias("bhids"))


@query("""select cast(l_orderkey as varchar) as bhid, count(*) as n from lineitem anti join (select o_orderkey from orders where o_orderstatus <> 'P') o on l_orderkey = o_orderkey group by 1""")
def dh_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("bhid"))
    return drillhole.orphans(intervals(spark, sf_dir), collars(spark, sf_dir).join(known, "bhid", "left_semi"))


@query("""select bhid, x, y, z, eoh from (select cast(l_orderkey as varchar) bhid, cast(l_partkey as double) x, cast(l_suppkey as double) y, l_quantity z, l_extendedprice eoh, row_number() over (partition by l_orderkey order by -l_linenumber, l_partkey, l_suppkey) p from lineitem where l_linenumber <> 3) where p = 1""")
def dh_first_collars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a hole's several collars the first valid one by a column of row numbers; every third line has no elevation."""
    li = table(spark, sf_dir, "lineitem")
    z = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    rows = li.select(F.col("l_orderkey").cast("string").alias("bhid"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), z.alias("z"), F.col("l_extendedprice").alias("eoh"), F.struct(-F.col("l_linenumber"), "l_partkey", "l_suppkey").alias("n"))
    return drillhole.first_collars(rows, "n")


@query("""with s as (select cast(l_orderkey as varchar) bhid, cast(l_linenumber // 2 as double) depth, l_discount * 1000 az, l_tax * 1000 dip, row_number() over (partition by l_orderkey, l_linenumber // 2 order by l_linenumber desc, l_extendedprice desc, l_partkey desc, l_suppkey desc) p from lineitem where l_tax * 1000 <= 90),
    k as (select bhid, depth, az, dip from s where p = 1), u as (select * from k union all select bhid, 0.0, arg_min(az, depth), arg_min(dip, depth) from k group by 1 having min(depth) > 0 union all select cast(o_orderkey as varchar), 0.0, 0.0, 90.0 from orders where cast(o_orderkey as varchar) not in (select bhid from k))
    select bhid, depth, round(az, 6) as az, round(dip, 6) as dip, cast(row_number() over (partition by bhid order by depth) as int) as station from u where bhid in (select cast(o_orderkey as varchar) from orders)""")
def dh_last_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several stations at one depth the last usable one by a column of row numbers."""
    li = table(spark, sf_dir, "lineitem")
    n = F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey").alias("n")
    rows = li.select(F.col("l_orderkey").cast("string").alias("bhid"), F.floor(F.col("l_linenumber") / 2).cast("double").alias("depth"), (F.col("l_discount") * 1000).alias("az"), (F.col("l_tax") * 1000).alias("dip"), n)
    return rounded(drillhole.clean_surveys(rows, drillhole.first_collars(collars(spark, sf_dir)), order="n"), az=6, dip=6)


@query(f"""with {_PATH} select bhid, d0, d1, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(theta, 6) as theta from p""")
def dh_desurvey_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_path(spark, sf_dir), x=6, y=6, z=6, theta=6).select("bhid", "d0", "d1", "x", "y", "z", "theta")


@query(f"""with {_PATH.replace("case when theta <= 1e-6 then 1.0 else 2.0 / theta * tan(theta / 2.0) end rf", "1.0 rf")} select bhid, d0, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from p""")
def dh_desurvey_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_path(spark, sf_dir, "balanced-tangential"), x=6, y=6, z=6).select("bhid", "d0", "x", "y", "z")


_TANGENT = _PATH.replace("0.5 * dl * (tx + nx) * rf", "dl * nx").replace("0.5 * dl * (ty + ny) * rf", "dl * ny").replace("0.5 * dl * (tz + nz) * rf", "dl * nz")


@query(f"""with {_TANGENT} select bhid, d0, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from p""")
def dh_desurvey_tangential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_path(spark, sf_dir, "tangential"), x=6, y=6, z=6).select("bhid", "d0", "x", "y", "z")


@query("""with d as (select if(o_orderkey % 3 = 0, 1, -1) * (60 + month(o_orderdate)) dip from orders), s as (select dip, row_number() over (order by dip) - 1 i, count(*) over () n from d where dip <> 0) select case when dip < 0 then 'neg-down' else 'pos-down' end as convention from s where i = n // 2""")
def dh_dip_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    dips = table(spark, sf_dir, "orders").select((F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(-1) * (60 + F.month("o_orderdate"))).cast("double").alias("dip"))
    return spark.createDataFrame([(drillhole.dip_convention(dips),)], "convention string")


@query(f"""with {_PATH}, {_I}, q as (select bhid, f, (f + t) / 2 mid from i) select q.bhid, f, mid, {_at('x', 'mid')} as px, {_at('y', 'mid')} as py, {_at('z', 'mid')} as pz from q join p on q.bhid = p.bhid and (mid >= d0 or d0 = 0) and (d1 is null or mid < d1)""")
def dh_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = intervals(spark, sf_dir).select("bhid", F.col("from").alias("f"), ((F.col("from") + F.col("to")) / 2).alias("mid"))
    return rounded(drillhole.positions(points, _path(spark, sf_dir), "mid"), px=6, py=6, pz=6)


@query(f"""with {_PATH}, {_I}, q as (select *, t - f as length, (f + t) / 2 mid from i) select q.bhid, f, t, length, mid, l_discount, {_at('x', 'mid')} as px, {_at('y', 'mid')} as py, {_at('z', 'mid')} as pz from q join p on q.bhid = p.bhid and (mid >= d0 or d0 = 0) and (d1 is null or mid < d1)""")
def dh_desurvey_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drillhole.desurvey_intervals(collars(spark, sf_dir), surveys(spark, sf_dir), intervals(spark, sf_dir).select("bhid", "from", "to", "l_discount"))
    return rounded(rows, px=6, py=6, pz=6)


def _windows(length: float, split: str | None = None) -> str:
    run = f"r as (select *, sum(n) over (partition by bhid order by f, t rows unbounded preceding) run from (select *, case when {split} is distinct from lag({split}) over (partition by bhid order by f, t) or row_number() over (partition by bhid order by f, t) = 1 then 1 else 0 end n from i0))" if split else "r as (select *, 1 run from i0)"
    return f"""{run}, b as (select *, min(f) over (partition by bhid, run) a, max(t) over (partition by bhid, run) z from r),
        w as (select *, a + k * {length} w0, least(a + (k + 1) * {length}, z) w1 from b, lateral (select unnest(generate_series(cast(least(floor((f - a) / {length}), greatest(ceil((z - a - 1e-9) / {length}) - 1, 0)) as bigint), cast(least(floor((t - a) / {length}), greatest(ceil((z - a - 1e-9) / {length}) - 1, 0)) as bigint))) k)),
        o as (select *, greatest(f, w0) lo, least(t, w1) hi, least(t, w1) - greatest(f, w0) len from w where least(t, w1) - greatest(f, w0) > 1e-12)"""


# One interval per place: of lines with one number, the sums.
_ONE = "i0 as (select cast(l_orderkey as varchar) bhid, cast(l_linenumber - 1 as double) f, cast(l_linenumber as double) t, avg(l_discount) l_discount, sum(l_quantity) l_quantity, min(l_returnflag) l_returnflag from lineitem group by 1, 2, 3)"


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(intervals(spark, sf_dir), "bhid").groupBy("bhid", F.col("from").alias("f"), F.col("to").alias("t"))
    return rows.agg(F.avg("l_discount").alias("l_discount"), F.sum("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"))


@query(f"""with {_ONE}, {_windows(2.0)} select bhid, k as "window", w0 as "from", w1 as "to", round(sum(len), 6) as support, round(sum(len * (lo + hi) / 2) / sum(len), 6) as mid, round(sum(l_discount * len) / sum(len), 9) as l_discount, round(sum(l_quantity * len), 4) as l_quantity from o group by bhid, k, w0, w1""")
def dh_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drillhole.composite(_single(spark, sf_dir), 2.0, {"l_discount": "mean", "l_quantity": "sum"}, by_hole=True)
    return rounded(rows, support=6, mid=6, l_discount=9, l_quantity=4).drop("run", "mixed")


@query(f"""with {_ONE}, {_windows(3.0)} select bhid, k as "window", w0 as "from", w1 as "to", round(sum(l_discount * len * l_quantity) / sum(len * l_quantity), 11) as l_discount, round(sum(l_quantity * len) / sum(len), 11) as l_quantity from o group by bhid, k, w0, w1 having sum(len) / (w1 - w0) >= 0.6""")
def dh_composite_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drillhole.composite(_single(spark, sf_dir), 3.0, {"l_discount": "mean", "l_quantity": "mean"}, density="l_quantity", min_coverage=0.6, by_hole=True)
    return rounded(rows, l_discount=11, l_quantity=11).select("bhid", "window", "from", "to", "l_discount", "l_quantity")


@query(f"""with {_ONE}, {_windows(2.0, 'l_returnflag')} select bhid, cast(run as bigint) as run, k as "window", w0 as "from", w1 as "to", round(sum(l_discount * len) / sum(len), 9) as l_discount, any_value(l_returnflag) as l_returnflag from o group by bhid, run, k, w0, w1""")
def dh_composite_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drillhole.composite(_single(spark, sf_dir), 2.0, {"l_discount": "mean"}, {"l_returnflag": "first"}, split=("l_returnflag",), by_hole=True)
    return rounded(rows, l_discount=9).select("bhid", "run", "window", "from", "to", "l_discount", "l_returnflag")


@query(f"""with {_ONE}, {_windows(3.0)}, m as (select bhid, k, w0, w1, l_returnflag, sum(len) n, min(lo) top from o group by 1, 2, 3, 4, 5) select bhid, k as "window", w0 as "from", arg_min(l_returnflag, (-n, top, l_returnflag)) as l_returnflag, count(*) > 1 as mixed from m group by bhid, k, w0""")
def dh_composite_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drillhole.composite(_single(spark, sf_dir), 3.0, {"l_discount": "mean"}, {"l_returnflag": "majority"}, by_hole=True)
    return rows.select("bhid", "window", "from", "l_returnflag", "mixed")


@query(f"""with {_PATH}, {_ONE}, {_windows(2.0)}, k as (select bhid, k as win, w0, w1, sum(len) support, sum(len * (lo + hi) / 2) / sum(len) mid, sum(l_discount * len) / sum(len) l_discount from o group by bhid, k, w0, w1)
    select k.bhid, win as "window", w0 as "from", w1 as "to", round(support, 6) as support, round(l_discount, 11) as l_discount, {_at('x', 'mid')} as x, {_at('y', 'mid')} as y, {_at('z', 'mid')} as z from k join p on k.bhid = p.bhid and (mid >= d0 or d0 = 0) and (d1 is null or mid < d1)""")
def dh_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from three tables to a weighed point dataset."""
    iv = _single(spark, sf_dir).withColumnsRenamed({"f": "from", "t": "to"})
    points = drillhole.emit("composite", collars(spark, sf_dir), surveys(spark, sf_dir), iv, length=2.0, numeric={"l_discount": "mean"}, convention="pos-down")
    return rounded(points.frame().select("bhid", "window", "from", "to", points.weight, "l_discount", "x", "y", "z"), support=6, l_discount=11, x=6, y=6, z=6)


@query("""select coalesce(arg_min(length, (-n, length)), 1.0) as length from (select round(t - f, 2) length, count(*) n from (select cast(l_linenumber - 1 as double) f, l_linenumber - 1 + l_quantity / 7.0 t from lineitem) where t > f group by 1)""")
def dh_default_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).cast("double").alias("from"), (F.col("l_linenumber") - 1 + F.col("l_quantity") / 7.0).alias("to"))
    return drillhole.default_length(rows)


@query("""with v as (select l_quantity / 7.0 v from lineitem), s as (select min(v) lo, (max(v) - min(v)) / 14 step from v) select bin, round(lo + bin * step, 6) as low, round(lo + (bin + 1) * step, 6) as high, n from (select cast(least(floor((v - lo) / step), 13) as int) bin, any_value(lo) lo, any_value(step) step, count(*) n from v, s group by 1)""")
def dh_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 7.0).alias("v"))
    return rounded(drillhole.length_histogram(rows, "v"), low=6, high=6)


@query("""with a as (select cast(l_orderkey as varchar) bhid, cast(l_linenumber - 1 as double) f, cast(l_linenumber as double) t, sum(l_quantity) qa from lineitem group by 1, 2, 3), b as (select cast(l_orderkey as varchar) bhid, 0.75 * (l_linenumber - 1) f, 0.75 * l_linenumber t, max(l_discount) qb from lineitem group by 1, 2, 3),
    c as (select bhid, f d from a union select bhid, t from a union select bhid, f from b union select bhid, t from b), s as (select bhid, d f, lead(d) over (partition by bhid order by d) t from c), m as (select *, (f + t) / 2 mid from s where t is not null)
    select m.bhid, cast(m.f as double) as "from", cast(m.t as double) as "to", a.qa, b.qb from m left join a on m.bhid = a.bhid and a.f <= mid and mid <= a.t left join b on m.bhid = b.bhid and b.f <= mid and mid <= b.t where a.qa is not null or b.qb is not null""")
def dh_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = dealt(intervals(spark, sf_dir), "bhid")
    a = iv.groupBy("bhid", "from", "to").agg(F.sum("l_quantity").alias("qa"))
    b = iv.groupBy("bhid", (0.75 * F.col("from")).alias("from"), (0.75 * F.col("to")).alias("to")).agg(F.max("l_discount").alias("qb"))
    return drillhole.merge(a, b)[0]


@query("""with a as (select distinct cast(l_orderkey as varchar) bhid, cast(l_linenumber - 1 as double) f, cast(l_linenumber as double) t from lineitem), b as (select * from a where t > 2), c as (select bhid, f d from a union select bhid, t from a), s as (select bhid, d f, lead(d) over (partition by bhid order by d) t from c), m as (select *, (f + t) / 2 mid from s where t is not null),
    j as (select m.bhid, m.f, count(a.f) na, count(b.f) nb from m left join a on m.bhid = a.bhid and a.f <= mid and mid <= a.t left join b on m.bhid = b.bhid and b.f <= mid and mid <= b.t group by 1, 2), h as (select distinct bhid from b)
    select 'gap-a' as check_id, count(*) filter (na = 0 and nb > 0) as "count" from j union all select 'gap-b', count(*) filter (na > 0 and nb = 0 and bhid in (select bhid from h)) from j union all select 'overlap-a', count(*) filter (na > 1) from j union all select 'overlap-b', count(*) filter (nb > 1) from j
    union all select 'hole-only-a', count(*) from (select distinct bhid from a where bhid not in (select bhid from h)) union all select 'hole-only-b', 0 union all select 'column-collision', 1""")
def dh_merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = dealt(intervals(spark, sf_dir).select("bhid", "from", "to"), "bhid").distinct().withColumn("v", F.lit(1))
    return drillhole.merge(a, a.where("to > 2"))[1]


_THREE = """a as (select cast(l_orderkey as varchar) bhid, cast(l_linenumber - 1 as double) f, cast(l_linenumber as double) t, sum(l_quantity) q from lineitem group by 1, 2, 3), b as (select cast(l_orderkey as varchar) bhid, 0.75 * (l_linenumber - 1) f, 0.75 * l_linenumber t, max(l_discount) q from lineitem group by 1, 2, 3),
    c as (select cast(l_orderkey as varchar) bhid, cast(l_linenumber - 1 as double) f, l_linenumber + 1.625 t, min(l_tax) q, count(*) n from lineitem where l_linenumber % 2 = 0 group by 1, 2, 3),
    d as (select bhid, f d from a union select bhid, t from a union select bhid, f from b union select bhid, t from b union select bhid, f from c union select bhid, t from c), s as (select bhid, d f, lead(d) over (partition by bhid order by d) t from d), m as (select *, (f + t) / 2 mid from s where t is not null),
    ca as (select m.bhid, m.f, count(*) k, arg_min(q, a.f) q from m join a on m.bhid = a.bhid and a.f <= mid and mid <= a.t group by 1, 2), cb as (select m.bhid, m.f, count(*) k, arg_min(q, b.f) q from m join b on m.bhid = b.bhid and b.f <= mid and mid <= b.t group by 1, 2),
    cc as (select m.bhid, m.f, count(*) k, arg_min(q, c.f) q, arg_min(n, c.f) n from m join c on m.bhid = c.bhid and c.f <= mid and mid <= c.t group by 1, 2),
    j as (select m.bhid, m.f, m.t, ca.q qa, cb.q qb, cc.q qc, cc.n, coalesce(ca.k, 0) ka, coalesce(cb.k, 0) kb, coalesce(cc.k, 0) kc from m left join ca on m.bhid = ca.bhid and m.f = ca.f left join cb on m.bhid = cb.bhid and m.f = cb.f left join cc on m.bhid = cc.bhid and m.f = cc.f where ca.k > 0 or cb.k > 0 or cc.k > 0)"""


def _three(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Intervals of one line, of three quarters of one, and of 2.625 of every other one, which overlap."""
    iv = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("bhid"), (F.col("l_linenumber") - 1).cast("double").alias("from"), F.col("l_linenumber").cast("double").alias("to"), "l_linenumber", "l_quantity", "l_discount", "l_tax")
    iv = dealt(iv, "bhid")
    a = iv.groupBy("bhid", "from", "to").agg(F.sum("l_quantity").alias("q"))
    b = iv.groupBy("bhid", (0.75 * F.col("from")).alias("from"), (0.75 * F.col("to")).alias("to")).agg(F.max("l_discount").alias("q"))
    c = iv.where("l_linenumber % 2 = 0").groupBy("bhid", "from", (F.col("to") + 1.625).alias("to")).agg(F.min("l_tax").alias("q"), F.count("*").alias("n"))
    return [a, b, c]


@query(f"""with {_THREE} select bhid, cast(f as double) as "from", cast(t as double) as "to", qa as q, qb as q_2, qc as q_3, n from j""")
def dh_merge_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drillhole.merge_all(_three(spark, sf_dir))[0]


@query(f"""with {_THREE}, h as (select distinct bhid from c)
    select 'gap-a' as check_id, count(*) filter (ka = 0) as "count" from j union all select 'gap-b', count(*) filter (kb = 0) from j union all select 'gap-c', count(*) filter (kc = 0 and bhid in (select bhid from h)) from j
    union all select 'overlap-a', count(*) filter (ka > 1) from j union all select 'overlap-b', count(*) filter (kb > 1) from j union all select 'overlap-c', count(*) filter (kc > 1) from j union all select 'hole-only-' || x, 0 from (select unnest(['a', 'b', 'c']) x) union all select 'column-collision', 2""")
def dh_merge_three_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drillhole.merge_all(_three(spark, sf_dir))[1]
