"""Queries over the block model: statistics, categories, grade-tonnage, swath, top-cut, section, geometry, declustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import categories, declustering, geometry, grade_tonnage, section, statistics, swath, topcut
from ..operators.states import merge_digests, merge_moments
from ..sources.text import with_row_id
from .registry import BM, block_model, query, rounded, table

GRADES = ("l_discount", "l_tax", "l_extendedprice")


def _moments_sql(variable: str, w: str | None, group: str | None = None, v: str | None = None) -> str:
    v, g = v or variable, f"{group} as \"group\", " if group else ""
    by = f"group by {group}" if group else ""
    if w is None:
        return f"""select '{variable}' as variable, {g} count({v}) as "count", count(*) - count({v}) as nulls, count(*) filter ({v} = 0) as zeros, cast(count({v}) as double) as sum_w,
            min({v}) as min, max({v}) as max, round(avg({v}), 6) as mean, round(stddev_samp({v}), 6) as std, round(skewness({v}), 5) as skew, round(kurtosis({v}), 5) as kurt, round(abs(stddev_samp({v}) / avg({v}) * 100), 5) as cv from lineitem {by}"""
    return f"""select '{variable}' as variable, count(*) as "count", cast(0 as bigint) as nulls, count(*) filter ({v} = 0) as zeros, round(sum({w}), 4) as sum_w, min({v}) as min, max({v}) as max,
        round(any_value(m), 6) as mean, round(sqrt(sum({w} * ({v} - m) ** 2) / sum({w})), 6) as std,
        round(sqrt(sum({w})) * sum({w} * ({v} - m) ** 3) / sum({w} * ({v} - m) ** 2) ** 1.5, 5) as skew,
        round(sum({w}) * sum({w} * ({v} - m) ** 4) / sum({w} * ({v} - m) ** 2) ** 2 - 3, 5) as kurt, round(abs(sqrt(sum({w} * ({v} - m) ** 2) / sum({w})) / any_value(m) * 100), 5) as cv
        from lineitem, (select sum({v} * {w}) / sum({w}) m from lineitem)"""


_DIGITS = {"mean": 6, "std": 6, "skew": 5, "kurt": 5, "cv": 5}


@query(" union all ".join(_moments_sql(v, None) for v in GRADES))
def moments_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.moments(block_model(spark, sf_dir), list(GRADES)), **_DIGITS)


@query(" union all ".join(_moments_sql(v, "l_quantity") for v in GRADES))
def moments_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.moments(block_model(spark, sf_dir), list(GRADES), "l_quantity"), sum_w=4, **_DIGITS)


def _grouped_weighted_sql(v: str, w: str, g: str) -> str:
    """Weighted moments of every group about its own mean."""
    return f"""select '{v}' as variable, r.g as "group", count(*) as "count", cast(0 as bigint) as nulls, count(*) filter ({v} = 0) as zeros, round(sum({w}), 4) as sum_w, min({v}) as min, max({v}) as max,
        round(any_value(m), 6) as mean, round(sqrt(sum({w} * ({v} - m) ** 2) / sum({w})), 6) as std,
        round(sqrt(sum({w})) * sum({w} * ({v} - m) ** 3) / sum({w} * ({v} - m) ** 2) ** 1.5, 5) as skew,
        round(sum({w}) * sum({w} * ({v} - m) ** 4) / sum({w} * ({v} - m) ** 2) ** 2 - 3, 5) as kurt, round(abs(sqrt(sum({w} * ({v} - m) ** 2) / sum({w})) / any_value(m) * 100), 5) as cv
        from (select *, {g} g from lineitem) r join (select {g} g, sum({v} * {w}) / sum({w}) m from lineitem group by 1) x on r.g = x.g group by r.g"""


@query(" union all ".join(_grouped_weighted_sql(v, "l_quantity", "l_returnflag") for v in GRADES))
def moments_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States made of two parts of the table, kept apart and merged, by group and weight."""
    bm = block_model(spark, sf_dir)
    parts = [statistics.states_of_moments(bm.where(half), list(GRADES), "l_quantity", "l_returnflag") for half in ("l_linenumber <= 3", "l_linenumber > 3")]
    return rounded(statistics.moments_of(merge_moments(parts[0].unionByName(parts[1]))), sum_w=4, **_DIGITS)


@query(_moments_sql("l_discount", None, v="nullif(l_discount, 0)"))
def moments_colfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.moments(block_model(spark, sf_dir), ["l_discount"], skip_zeros=("l_discount",), skip_negatives=("l_discount",)), **_DIGITS)


@query(" union all ".join(_moments_sql(v, None, "l_returnflag") for v in GRADES).replace('as cv from', 'as cv, false as overflow from'))
def grouped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(categories.grouped_statistics(block_model(spark, sf_dir), list(GRADES), "l_returnflag"), **_DIGITS)


def _quantile_sql(v: str, w: str, qs: tuple[float, ...], source: str = "lineitem", name: str = "") -> str:
    """Quantiles by mid-points of distinct values."""
    return f"""select q, round(coalesce(max(case when t < mid and (pm is null or t >= pm) then case when pm is null then v else pv + (v - pv) * (t - pm) / (mid - pm) end end), max(v)), 6) as "value"
        from (select *, q * total as t from (select *, lag(mid) over (order by v) pm, lag(v) over (order by v) pv from
        (select v, sum(c) over (order by v) - c / 2 as mid, sum(c) over () as total from (select {v} v, cast(sum({w}) as double) c from {source} group by 1))), (select unnest([{', '.join(f'cast({q} as double)' for q in qs)}]) q)) group by q"""


_Q = (0.1, 0.25, 0.5, 0.75, 0.9)


@query(_quantile_sql("l_extendedprice", "1", _Q))
def quantiles_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.quantiles(block_model(spark, sf_dir), "l_extendedprice"), value=6)


@query(_quantile_sql("l_discount", "l_quantity", _Q))
def quantiles_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.quantiles(block_model(spark, sf_dir), "l_discount", weight="l_quantity"), value=6)


@query("""select "group", q, min(v) filter (cum >= q * total) as "value" from (select "group", v, sum(c) over (partition by "group" order by v) cum, sum(c) over (partition by "group") total from
    (select l_returnflag as "group", l_extendedprice v, cast(count(*) as double) c from lineitem group by 1, 2)), (select unnest([cast(0.1 as double), 0.5, 0.9]) q) group by 1, 2""")
def percentile_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.step_percentiles(block_model(spark, sf_dir), "l_extendedprice", (0.1, 0.5, 0.9), group="l_returnflag")


@query("""select l_returnflag as "group", q, true as within from lineitem, (select unnest([cast(0.1 as double), 0.25, 0.5, 0.75, 0.9]) q) group by 1, 2""")
def quantiles_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each sketched quantile lies within a thousandth of the rows of its exact rank."""
    df = block_model(spark, sf_dir)
    found = statistics.approximate_quantiles(df, "l_extendedprice", group="l_returnflag")
    ranked = df.select(F.col("l_returnflag").alias("group"), F.col("l_extendedprice").alias("v")).join(F.broadcast(found), "group")  # five rows a group of three
    shares = ranked.groupBy("group", "q").agg((F.count_if(F.col("v") < F.col("value")) / F.count("*")).alias("below"), (F.count_if(F.col("v") <= F.col("value")) / F.count("*")).alias("upto"))
    return shares.select("group", "q", ((F.col("below") <= F.col("q") + 0.001) & (F.col("upto") >= F.col("q") - 0.001)).alias("within"))


_Q13 = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


@query(" union all ".join(f"select '{v}' as variable, q, \"value\" from ({_quantile_sql(v, '1', _Q13)})" for v in ("l_quantity", "l_discount")))
def quantiles_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of two parts of the table, merged; with few distinct values they are exact."""
    bm = block_model(spark, sf_dir)
    parts = [statistics.digest(bm.where(half), ["l_quantity", "l_discount"]) for half in ("l_linenumber <= 3", "l_linenumber > 3")]
    return rounded(statistics.digest_quantiles(merge_digests(parts[0].unionByName(parts[1])), _Q13), value=6)


@query(f"""select g as "group", q, "value" as exact, true as within from (select 'A' g, * from ({_quantile_sql('l_extendedprice', 'l_quantity', _Q13, "(select * from lineitem where l_returnflag = 'A')")}) union all select 'N', * from ({_quantile_sql('l_extendedprice', 'l_quantity', _Q13, "(select * from lineitem where l_returnflag = 'N')")}) union all select 'R', * from ({_quantile_sql('l_extendedprice', 'l_quantity', _Q13, "(select * from lineitem where l_returnflag = 'R')")}))""")
def digest_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles by weight and group, and whether the digest, held to 500 exact values, is within 0.5 % of them."""
    bm = block_model(spark, sf_dir)
    parts = [statistics.digest(bm.where(half), ["l_extendedprice"], "l_quantity", "l_returnflag", exact_values=500) for half in ("l_linenumber <= 3", "l_linenumber > 3")]
    found = statistics.digest_quantiles(merge_digests(parts[0].unionByName(parts[1]), exact_values=500), _Q13).withColumnRenamed("value", "about")
    exact = statistics.quantiles(bm, "l_extendedprice", _Q13, "l_quantity", "l_returnflag")
    return rounded(exact.join(found, ["group", "q"]).select("group", "q", F.col("value").alias("exact"), (F.abs(F.col("about") - F.col("value")) <= 0.005 * F.col("value")).alias("within")), exact=6)


_AT = (-1.0, 0.0, 0.013, 0.02, 0.045, 0.1, 3.0)


@query(f"""with c as (select l_discount v, cast(count(*) as double) c from lineitem group by 1), p as (select v, sum(c) over (order by v) / sum(c) over () s from c), w as (select v, s, lag(v) over (order by v) pv, lag(s) over (order by v) ps from p)
    select x as "at", round(case when x <= (select min(v) from p) then 0.0 when x >= (select max(v) from p) then 1.0 else (select ps + (x - pv) / (v - pv) * (s - ps) from w where pv < x and x <= v) end, 9) as share from (select unnest([{', '.join(f'cast({x} as double)' for x in _AT)}]) x)""")
def share_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows at given values, read off a digest."""
    held = statistics.digest(block_model(spark, sf_dir), ["l_discount"]).select(F.col("mean").alias("value"), F.col("weight").alias("c"))
    return rounded(statistics.shares_at(held, _AT), share=9)


@query("""select v as "value", round(sum(c) over (order by v) / sum(c) over (), 8) as share from (select l_quantity v, cast(count(*) as double) c from lineitem group by 1)""")
def cdf_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.cdf_points(block_model(spark, sf_dir), "l_quantity"), share=8)


_PERCENTS = tuple(k / 100 for k in range(1, 100))


@query(f"""select a.q, a."value" as a, b."value" as b from ({_quantile_sql('l_extendedprice', '1', _PERCENTS)}) a join ({_quantile_sql('p_retailprice', '1', _PERCENTS, 'part')}) b on a.q = b.q""")
def qq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.qq_pairs(block_model(spark, sf_dir), "l_extendedprice", table(spark, sf_dir, "part"), "p_retailprice"), a=6, b=6)


def _normal_sql(p: str) -> str:
    from ..functions.scalar import _A, _B, _C, _D

    poly = lambda x, cs: "(" + "(" * (len(cs) - 1) + f"cast({cs[0]!r} as double)" + "".join(f" * {x} + cast({c!r} as double))" for c in cs[1:]) + ")"
    q = f"({p} - 0.5)"
    lo, hi = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    tail = lambda t: f"({poly(t, _C)} / ({poly(t, _D)} * {t} + 1.0))"
    return f"case when {p} < 0.02425 then {tail(lo)} when {p} > 1 - 0.02425 then -{tail(hi)} else {poly(f'({q} * {q})', _A)} * {q} / ({poly(f'({q} * {q})', _B)} * {q} * {q} + 1.0) end"


@query(f"""select v as "value", round(p, 8) as p, round({_normal_sql('p')}, 6) as score from (select v, (sum(c) over (order by v) - c / 2) / sum(c) over () as p from (select l_quantity v, cast(count(*) as double) c from lineitem where l_quantity > 0 group by 1))""")
def logprob_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.log_probability_points(block_model(spark, sf_dir), "l_quantity"), p=8, score=6)


@query("""select metric, round(a, 4) as "primary", round(b, 4) as reference, round((a - b) / abs(b) * 100, 4) as delta_pct, 'price' as variable from
    (select min(l_extendedprice) mi, max(l_extendedprice) ma, avg(l_extendedprice) me, stddev_samp(l_extendedprice) st from lineitem) l,
    (select min(p_retailprice) mi, max(p_retailprice) ma, avg(p_retailprice) me, stddev_samp(p_retailprice) st from part) p,
    lateral (values ('min', l.mi, p.mi), ('max', l.ma, p.ma), ('mean', l.me, p.me), ('std', l.st, p.st), ('cv', abs(l.st / l.me * 100), abs(p.st / p.me * 100))) t(metric, a, b)""")
def delta_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = statistics.moments(block_model(spark, sf_dir).withColumnRenamed("l_extendedprice", "Price"), ["Price"])
    b = statistics.moments(table(spark, sf_dir, "part").withColumnRenamed("p_retailprice", "price "), ["price "])
    return rounded(statistics.relative_differences(a, b), primary=4, reference=4, delta_pct=4)


@query("""select axis, min(v) as "min", max(v) as "max", max(v) - min(v) as extent from (select unnest(['x', 'y', 'z']) as axis, unnest([cast(l_partkey as double), l_suppkey, l_linenumber]) as v from lineitem) group by axis""")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.bounding_box(block_model(spark, sf_dir), {a: a for a in "xyz"})


@query("""select 'l_discount' as "column", 'numeric' as type, count(nullif(l_discount, 0.05)) as "count", count(*) - count(nullif(l_discount, 0.05)) as nulls, count(*) filter (l_discount = 0) as zeros,
    round(count(nullif(l_discount, 0.05)) * 100.0 / count(*), 6) as completeness, min(nullif(l_discount, 0.05)) as "min", max(nullif(l_discount, 0.05)) as "max", cast(null as bigint) as "distinct" from lineitem
    union all select 'l_returnflag', 'categorical', count(nullif(l_returnflag, 'N')), count(*) - count(nullif(l_returnflag, 'N')), null, round(count(nullif(l_returnflag, 'N')) * 100.0 / count(*), 6), null, null, count(distinct nullif(l_returnflag, 'N')) from lineitem""")
def column_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = block_model(spark, sf_dir).withColumns({"l_discount": F.nullif("l_discount", F.lit(0.05)), "l_returnflag": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))})
    return rounded(statistics.column_overview(df, ["l_discount"], ["l_returnflag"]), completeness=6)


# Categories


@query("""select 'event_type' as "column", event_type as "value", count(*) as n, false as overflow from events group by 2""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.counts(table(spark, sf_dir, "events"), ["event_type"])


@query("""select 'event_type' as "column", event_type as "value", n, cast(row_number() over (order by n desc, event_type) as int) as place, round(n * 100.0 / sum(n) over (), 6) as share,
    round(sum(n) over (order by n desc, event_type rows unbounded preceding) * 100.0 / sum(n) over (), 6) as cumulative, false as overflow from (select event_type, count(*) n from events group by 1)""")
def category_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(categories.pareto(table(spark, sf_dir, "events"), ["event_type"]), share=6, cumulative=6)


def _summary_sql(column: str, table: str) -> str:
    return f"""with c as (select cast({column} as varchar) v, count(*) n from {table} group by 1), s as (select *, n * 1.0 / sum(n) over () as s, sum(n) over () as t, coalesce(sum(n) over (order by n desc, v rows between unbounded preceding and 1 preceding), 0) as before from c)
    select '{column}' as "column", count(*) as "distinct", cast(max(t) as bigint) as "rows", cast(0 as bigint) as nulls, arg_min(v, (-n, v)) as dominant, round(max(s) * 100, 6) as dominant_pct, round(-sum(s * log2(s)), 6) as entropy,
    round(log2(count(*)), 6) as max_entropy, cast(floor(-sum(s * log2(s)) / log2(count(*)) * 100 + 0.5) as bigint) as diversity_pct, count(*) filter (before < 0.8 * t) as covering_80 from s"""


@query(_summary_sql("event_type", "events"))
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(categories.summary(table(spark, sf_dir, "events"), ["event_type"]), dominant_pct=6, entropy=6, max_entropy=6)


@query(_summary_sql("l_partkey", "lineitem"))
def category_summary_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More values than a listing shows: the summary is over all of them."""
    return rounded(categories.summary(table(spark, sf_dir, "lineitem"), ["l_partkey"]), dominant_pct=6, entropy=6, max_entropy=6)


@query("""with c as (select cast(l_partkey as varchar) v, count(*) n from lineitem group by 1), r as (select *, cast(row_number() over (order by n desc, v) as int) place, sum(n) over () t, sum(n) over (order by n desc, v rows unbounded preceding) u, count(*) over () k from c)
    select 'l_partkey' as "column", v as "value", n, place, round(n * 100.0 / t, 6) as share, round(u * 100.0 / t, 6) as cumulative, k > 500 as overflow from r where place <= 500""")
def category_pareto_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(categories.pareto(table(spark, sf_dir, "lineitem"), ["l_partkey"]), share=6, cumulative=6)


@query("""with c as (select p_brand v, count(*) n from part group by 1), r as (select *, row_number() over (order by n desc, v) i, count(*) over () k from c) select 'p_brand' as "column", v as "value", n, false as overflow from r where k <= 30 or i <= 20""")
def category_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.shown(categories.counts(table(spark, sf_dir, "part"), ["p_brand"]))


_ACCENTED = "case when p_partkey % 4 = 0 then null when p_partkey % 4 = 1 then translate(p_type, 'AEO', 'ÄÉÓ') when p_partkey % 4 = 2 then lower(p_type) else p_type end"


@query(f"""with c as (select coalesce({_ACCENTED}, '∅') v, count(*) n from part group by 1) select v as "value", n, row_number() over (order by v = '∅', v collate de, v) as alpha, row_number() over (order by n desc, v) as by_count,
    row_number() over (order by case v when 'promo' then 1 when 'economy' then 2 else 3 end, n desc, v) as custom from c""")
def category_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of labels with accents, of either case and missing, in three orders."""
    counted = table(spark, sf_dir, "part").groupBy(F.coalesce(F.expr(_ACCENTED), F.lit(categories.MISSING)).alias("value")).agg(F.count("*").alias("n"))
    counted = categories.with_place(counted, "missing-last", name="alpha")
    counted = categories.with_place(counted, "count-desc", name="by_count")
    return categories.with_place(counted, "custom", ["promo", "economy"], name="custom")


@query("""select 'l_linestatus' as "column", l_returnflag as "group", l_linestatus as "value", count(*) as n, false as overflow from lineitem group by 2, 3""")
def grouped_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.counts(block_model(spark, sf_dir), ["l_linestatus"], "l_returnflag")


@query("""select coalesce(nullif(l_returnflag, 'N'), '∅') as a, l_linestatus as b, count(*) as n, cast(count(*) as double) as w, false as overflow from lineitem group by 1, 2""")
def crosstab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = block_model(spark, sf_dir).withColumn("l_returnflag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    return categories.crosstab(df, "l_returnflag", "l_linestatus")


@query("""select l_returnflag as a, cast(l_linenumber as varchar) as b, count(*) as n, round(sum(l_discount), 4) as w, false as overflow from lineitem where l_discount > 0 group by 1, 2""")
def crosstab_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(categories.crosstab(block_model(spark, sf_dir), "l_returnflag", "l_linenumber", "l_discount"), w=4)


@query("""select a, b, n as "count", round(n * 100.0 / sum(n) over (partition by a), 6) as row_pct, round(n * 100.0 / sum(n) over (partition by b), 6) as col_pct, round(n * 100.0 / sum(n) over (), 6) as total_pct
    from (select l_returnflag a, l_linestatus b, count(*) n from lineitem group by 1, 2)""")
def crosstab_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(categories.crosstab_shares(categories.crosstab_cells(block_model(spark, sf_dir), "l_returnflag", "l_linestatus")), row_pct=6, col_pct=6, total_pct=6)


@query("""select l_returnflag as a, l_linestatus as b, count(*) as total from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())""")
def crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.margins(categories.crosstab_cells(block_model(spark, sf_dir), "l_returnflag", "l_linestatus"))


@query("""with c as (select o_orderstatus a, l_linestatus b, cast(count(*) as double) n from lineitem join orders on l_orderkey = o_orderkey group by 1, 2), t as (select sum(n) total, sum(case when a = b then n else 0 end) d from c),
    e as (select sum(r * k) rk from (select a, sum(n) r from c group by 1) x join (select b, sum(n) k from c group by 1) y on a = b), p as (select total, d / total po, rk / (total * total) pe from t, e)
    select total, round(po, 8) as po, round(pe, 8) as pe, round((po - pe) / (1 - pe), 8) as kappa, case when (po - pe) / (1 - pe) < 0 then 'poor' when (po - pe) / (1 - pe) < 0.2 then 'slight' when (po - pe) / (1 - pe) < 0.4 then 'fair' else 'more' end as band from p""")
def crosstab_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(categories.agreement(categories.crosstab_cells(rows, "o_orderstatus", "l_linestatus")), po=8, pe=8, kappa=8)


_MANY = "c as (select cast(l_partkey as varchar) a, cast(l_suppkey as varchar) b, count(*) n, cast(count(*) as double) w from lineitem group by 1, 2)"


@query(f"""with {_MANY}, x as (select a, row_number() over (order by sum(n) desc, a) i from c group by a), y as (select b, row_number() over (order by sum(n) desc, b) i from c group by b)
    select a, b, n, w, (select count(*) > 200 from x) or (select count(*) > 200 from y) as overflow from c where a in (select a from x where i <= 200) and b in (select b from y where i <= 200)""")
def crosstab_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More labels than a table lists: the listing is cut and says so."""
    return categories.crosstab(block_model(spark, sf_dir), "l_partkey", "l_suppkey")


@query(f"""with {_MANY} select a, null as b, sum(n)::bigint as total from c group by 1 union all select null, b, sum(n)::bigint from c group by 2 union all select null, null, sum(n)::bigint from c""")
def crosstab_many_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margins of the same are of all labels."""
    return categories.margins(categories.crosstab_cells(block_model(spark, sf_dir), "l_partkey", "l_suppkey"))


@query("""select count(*) as total, count(*) filter (k) as kept, count(*) filter (k and l_discount > 0) as placed, count(*) filter (k and l_returnflag = 'N') as a_missing, cast(0 as bigint) as b_missing, count(*) filter (k and l_discount <= 0) as weight_excluded,
    round(coalesce(sum(l_discount) filter (k and l_discount > 0), 0), 4) as weight_total, count(distinct l_returnflag) filter (k and l_discount > 0) as a_labels, count(distinct l_partkey) filter (k and l_discount > 0) as b_labels, false as a_overflow, count(distinct l_partkey) filter (k and l_discount > 0) > 200 as b_overflow from (select *, l_quantity > 10 k from lineitem)""")
def crosstab_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = block_model(spark, sf_dir).withColumn("l_returnflag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    return rounded(categories.crosstab_tallies(df, "l_returnflag", "l_partkey", "l_discount", F.col("l_quantity") > 10), weight_total=4)


@query("""with a as (select o_orderpriority v, count(*) n from orders group by 1), b as (select c_mktsegment v, count(*) n from customer group by 1)
    select coalesce(a.v, b.v) as "value", coalesce(a.n, 0) as n_primary, round(coalesce(a.n * 100.0 / (select sum(n) from a), 0), 6) as share_primary, coalesce(b.n, 0) as n_other, round(coalesce(b.n * 100.0 / (select sum(n) from b), 0), 6) as share_other from a full join b on a.v = b.v""")
def category_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(categories.compare(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_orderpriority", "c_mktsegment"), share_primary=6, share_other=6)


@query("""select count(*) as n from lineitem where l_returnflag in ('A', 'R') and l_linestatus in ('F')""")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_model(spark, sf_dir).where(categories.category_filter({"l_returnflag": ["A", "R"], "l_linestatus": ["F"]})).agg(F.count("*").alias("n"))


# Grade-tonnage

_CUTOFFS = (0.0, 0.02, 0.045, 0.08)


def _gt_sql(group: str | None = None, t: str = "l_quantity", cutoffs=_CUTOFFS) -> str:
    g, gc, eq = (f'{group} as "group",', '"group",', 'r."group",') if group else ("", "", "")
    values = ", ".join(f"cast({c} as double)" for c in cutoffs)
    return f"""with s as (select min(l_discount) - 0.001 * (max(l_discount) - min(l_discount)) lo, max(l_discount) + 0.001 * (max(l_discount) - min(l_discount)) hi from lineitem),
        b as (select {g} greatest(least(floor((l_discount - lo) / ((hi - lo) / 10000)), 9999), 0) bin, any_value(lo) lo, any_value((hi - lo) / 10000) step, sum({t}) t, sum(l_discount * {t}) gt from lineitem, s group by {'1, 2' if group else '1'}),
        r as (select {gc} cutoff, t, gt, bin, greatest(least((cutoff - lo) / step, 9999.0), 0.0) as pos from b, (select unnest([{values}]) cutoff)),
        k as (select {eq} cutoff, pos - floor(pos) frac, sum(case when bin >= floor(pos) then t else 0 end) t0, sum(case when bin >= least(floor(pos) + 1, 9999) then t else 0 end) t1,
            sum(case when bin >= floor(pos) then gt else 0 end) m0, sum(case when bin >= least(floor(pos) + 1, 9999) then gt else 0 end) m1, sum(t) a from r group by {eq} cutoff, pos - floor(pos)),
        f as (select *, t0 + (t1 - t0) * frac tt, m0 + (m1 - m0) * frac mm, case when t0 > 0 then m0 / t0 else 0 end g0, case when t1 > 0 then m1 / t1 else 0 end g1 from k)
        select 'l_discount' as variable, {gc} cutoff, round(tt, 4) as tonnage, round(g0 + (g1 - g0) * frac, 6) as grade, round(mm, 4) as metal, round(tt * 100 / a, 6) as pct, round(case when tt > 0 then mm / tt else 0 end, 6) as grade_exact from f"""


_GT = {"tonnage": 4, "grade": 6, "metal": 4, "pct": 6, "grade_exact": 6}


@query(_gt_sql())
def gt_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = block_model(spark, sf_dir)
    cells = grade_tonnage.bins(df, {"l_discount": grade_tonnage.grade_range(df, "l_discount")}, density="l_quantity")
    return rounded(grade_tonnage.at_cutoffs(cells, list(_CUTOFFS)), **_GT)


@query(_gt_sql("l_returnflag"))
def gt_curve_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = block_model(spark, sf_dir)
    cells = grade_tonnage.bins(df, {"l_discount": grade_tonnage.grade_range(df, "l_discount")}, "l_returnflag", density="l_quantity")
    return rounded(grade_tonnage.at_cutoffs(cells, list(_CUTOFFS)), **_GT)


@query(_gt_sql(t="27.0"))
def gt_density_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = block_model(spark, sf_dir)
    cells = grade_tonnage.bins(df, {"l_discount": grade_tonnage.grade_range(df, "l_discount")}, block_volume=10.0, density=2.7)
    return rounded(grade_tonnage.at_cutoffs(cells, list(_CUTOFFS)), **_GT)


@query("""with s as (select min(l_discount) - 0.001 * (max(l_discount) - min(l_discount)) lo, max(l_discount) + 0.001 * (max(l_discount) - min(l_discount)) hi from lineitem),
    b as (select l_returnflag g, cast(greatest(least(floor((l_discount - lo) / ((hi - lo) / 10000)), 9999), 0) as int) bin, sum(l_quantity) t, sum(l_discount * l_quantity) m from lineitem, s group by 1, 2),
    d as (select g, cast(k as int) bin from (select distinct g from b), range(10000) r(k)), j as (select d.g, d.bin, coalesce(t, 0) t, coalesce(m, 0) m from d left join b on d.g = b.g and d.bin = b.bin),
    c as (select g, bin, sum(t) over w t, sum(m) over w m from j window w as (partition by g order by bin desc))
    select 'l_discount' as variable, g as "group", bin, round(lo + bin * ((hi - lo) / 10000), 8) as cutoff, round(t, 4) as tonnage, round(case when t > 0 then m / t else 0 end, 6) as grade, round(m, 4) as metal, false as overflow from c, s""")
def gt_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve at every bin, by group."""
    df = block_model(spark, sf_dir)
    cells = grade_tonnage.bins(df, {"l_discount": grade_tonnage.grade_range(df, "l_discount")}, "l_returnflag", density="l_quantity")
    return rounded(grade_tonnage.bin_curve(cells), cutoff=8, tonnage=4, grade=6, metal=4)


@query("""select cutoff, round(sum(case when l_discount >= cutoff then l_quantity else 0 end), 4) as tonnage from lineitem, (select unnest([cast(0.01 as double), 0.03, 0.05, 0.07, 0.09]) cutoff) group by 1""")
def gt_cutoff_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoffs by range and step, the end included."""
    cutoffs = grade_tonnage.cutoff_range(0.01, 0.09, 0.02)
    return rounded(grade_tonnage.exact(block_model(spark, sf_dir), "l_discount", cutoffs, density="l_quantity"), tonnage=4).select("cutoff", "tonnage")


@query("""select cutoff, round(sum(case when l_discount >= cutoff then l_quantity else 0 end), 4) as tonnage, round(sum(case when l_discount >= cutoff then l_quantity * l_discount else 0 end), 4) as metal,
    round(sum(case when l_discount >= cutoff then l_quantity * l_discount else 0 end) / sum(case when l_discount >= cutoff then l_quantity else 0 end), 6) as grade from lineitem, (select unnest([cast(0.0 as double), 0.02, 0.045, 0.08]) cutoff) group by 1""")
def gt_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grade_tonnage.exact(block_model(spark, sf_dir), "l_discount", list(_CUTOFFS), density="l_quantity"), tonnage=4, grade=6, metal=4)


@query("""with s as (select sum(l_quantity) w, sum(l_quantity * l_tax) / sum(l_quantity) m from lineitem), c as (select cutoff, m, w, m + (cutoff - m) / sqrt(0.6) x from s, (select unnest([cast(0.01 as double), 0.033, 0.05]) cutoff))
    select cutoff, round(sum(case when l_tax > x then l_quantity else 0 end) / any_value(w), 8) as t_frac, round(any_value(m) + sqrt(0.6) * (sum(case when l_tax > x then l_quantity * l_tax else 0 end) / sum(case when l_tax > x then l_quantity else 0 end) - any_value(m)), 8) as grade from lineitem, c group by cutoff""")
def gt_theoretical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grade_tonnage.theoretical(block_model(spark, sf_dir), "l_tax", [0.01, 0.033, 0.05], 0.6, "l_quantity"), t_frac=8, grade=8)


@query("""select 'density' as reason, count(*) as n from lineitem where l_discount <= 0 having count(*) > 0 union all select 'weight', count(*) from lineitem where l_discount > 0 and l_tax <= 0 having count(*) > 0""")
def gt_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_tonnage.exclusions(block_model(spark, sf_dir), density="l_discount", weight="l_tax")


# Swath


def _swath_sql(direction: str, coord: str, width: float, variables: tuple[str, ...], w: str | None = None) -> str:
    parts = []
    for v in variables:
        mean = f"sum({w} * {v}) / sum({w})" if w else f"avg({v})"
        std = f"sqrt(greatest(0, sum({w} * {v} * {v}) / sum({w}) - (sum({w} * {v}) / sum({w})) ** 2))" if w else f"coalesce(stddev_samp({v}), 0)"
        parts.append(f"""(with {BM} select '{direction}' as direction, cast(floor(({coord}) / {width}) as bigint) as bin, (floor(({coord}) / {width}) + 0.5) * {width} as centre, '{v}' as variable, count(*) as "count", round({mean}, 6) as mean, round({std}, 5) as std from bm group by 2, 3)""")
    return " union all ".join(parts)


@query(_swath_sql("x", "x", 50.0, ("l_discount",)))
def swath_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(swath.profile(block_model(spark, sf_dir), ["l_discount"], {"x": ("x", 50.0)}), mean=6, std=5)


@query(" union all ".join(_swath_sql(d, d, w, ("l_discount", "l_tax"), "l_quantity") for d, w in (("x", 100.0), ("y", 10.0), ("z", 1.0))))
def swath_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(swath.profile(block_model(spark, sf_dir), ["l_discount", "l_tax"], {"x": ("x", 100.0), "y": ("y", 10.0), "z": ("z", 1.0)}, weight="l_quantity"), mean=6, std=5)


_UVW = swath.rotated_frame(35.0, 60.0, 20.0)


@query(_swath_sql("u", " + ".join(f"cast({k!r} as double) * {a}" for k, a in zip(_UVW["u"], "xyz")), 75.0, ("l_tax",)))
def swath_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(swath.profile(block_model(spark, sf_dir), ["l_tax"], {"u": (_UVW["u"], 75.0)}), mean=6, std=5)


@query("""with a as (select floor(l_suppkey / 5.0) bin, count(*) n, avg(l_extendedprice) m, coalesce(stddev_samp(l_extendedprice), 0) s from lineitem group by 1), b as (select floor(p_size / 5.0) bin, count(*) n, avg(p_retailprice) m from part group by 1)
    select 'y' as direction, cast(a.bin as bigint) as bin, 'price' as variable, (a.bin + 0.5) * 5.0 as centre, a.n as "count", round(a.m, 4) as mean, round(a.s, 4) as std, b.n as other_count, round(b.m, 4) as other_mean from a left join b on a.bin = b.bin""")
def swath_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = swath.profile(block_model(spark, sf_dir).withColumnRenamed("l_extendedprice", "price"), ["price"], {"y": ("y", 5.0)})
    b = swath.profile(table(spark, sf_dir, "part").withColumnsRenamed({"p_size": "y", "p_retailprice": "price"}), ["price"], {"y": ("y", 5.0)})
    return rounded(swath.compare(a, b), mean=4, std=4, other_mean=4)


@query("""select bin, q, min(v) filter (cum >= q * total) as "value" from (select bin, v, sum(c) over (partition by bin order by v) cum, sum(c) over (partition by bin) total from
    (select cast(floor(l_suppkey / 20.0) as bigint) bin, l_extendedprice v, cast(count(*) as double) c from lineitem group by 1, 2)), (select unnest([cast(0.1 as double), 0.5, 0.9]) q) group by 1, 2""")
def swath_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swath.percentiles(block_model(spark, sf_dir), "l_extendedprice", "y", 20.0, (0.1, 0.5, 0.9))


# Top-cut

_CAPS = (20000.0, 50000.0, 80000.0, 120000.0)


@query(f"""with r as (select cap, l_extendedprice v, least(l_extendedprice, cap) c, l_quantity w from lineitem, (select unnest([{', '.join(map(str, _CAPS))}]::double[]) cap)), a as (select cap, count(*) filter (v > cap) as n_capped, sum(case when v > cap then w else 0 end) / sum(w) as cap_share,
    sum(w * c) / sum(w) as mean, sqrt(greatest(0, sum(w * c * c) / sum(w) - (sum(w * c) / sum(w)) ** 2)) as std, (sum(w * v) - sum(w * c)) / sum(w * v) * 100 as gone from r group by cap)
    select cap, n_capped, round(cap_share, 8) as cap_share, round(mean, 4) as mean, round(std, 3) as std, round(std / mean, 6) as cv, round(gone, 6) as metal_removed_pct from a""")
def topcut_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topcut.at_caps(block_model(spark, sf_dir), "l_extendedprice", list(_CAPS), "l_quantity"), cap_share=8, mean=4, std=3, cv=6, metal_removed_pct=6)


@query("""with s as (select min(l_extendedprice) lo, (max(l_extendedprice) - min(l_extendedprice)) / 50 step from lineitem)
    select bin, round(lo + bin * step, 4) as low, round(lo + (bin + 1) * step, 4) as high, n, w from (select cast(least(floor((l_extendedprice - lo) / step), 49) as int) bin, any_value(lo) lo, any_value(step) step, count(*) n, cast(count(*) as double) w from lineitem, s group by 1)""")
def topcut_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topcut.histogram(block_model(spark, sf_dir), "l_extendedprice"), low=4, high=4)


@query(f"""with m as (select (select "value" from ({_quantile_sql('l_extendedprice', '1', (0.5,)).replace('round(coalesce(', '(coalesce(').replace(', max(v)), 6)', ', max(v)))')})) lo, (select max(l_extendedprice) from lineitem) hi),
    caps as (select lo + (hi - lo) * k / 220 cap from m, range(221) t(k)), r as (select cap, l_extendedprice v, least(l_extendedprice, cap) c from lineitem, caps)
    select round(cap, 4) as cap, count(*) filter (v > cap) as n_capped, round(avg(c), 4) as mean, round(stddev_samp(c) / avg(c), 6) as cv, round((sum(v) - sum(c)) / sum(v) * 100, 6) as metal_removed_pct from r group by r.cap""")
def topcut_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(topcut.cap_curve(block_model(spark, sf_dir), "l_extendedprice"), cap=4, mean=4, cv=6, metal_removed_pct=6).select("cap", "n_capped", "mean", "cv", "metal_removed_pct")


# Section, geometry, declustering


@query("""select cast(l_partkey as double) as h, cast(l_suppkey as double) as v, cast(0 as double) as dh, cast(0 as double) as dv, l_discount as val from lineitem where l_linenumber >= 2.5 and l_linenumber <= 3.5""")
def section_slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section.slab(block_model(spark, sf_dir), "z", 3.0, 1.0, {a: a for a in "xyz"}, "l_discount")


@query(f"""with {BM}, d as (select 'x' axis, x v from bm union select 'y', y from bm union select 'z', z from bm), g as (select axis, round(v - lag(v) over (partition by axis order by v), 6) gap from d) select axis, gap, count(*) as n from g where gap is not null group by 1, 2""")
def geometry_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.spacing(block_model(spark, sf_dir), {a: a for a in "xyz"})


@query(f"""with {BM}, d as (select 'x' axis, x v from bm union select 'y', y from bm union select 'z', z from bm), g as (select axis, v - lag(v) over (partition by axis order by v) gap from d), h as (select axis, gap, count(*) n from g where gap is not null group by 1, 2),
    o as (select *, sum(n) over (partition by axis) t from h), k as (select axis, arg_max(gap, (n, -gap)) common, max(n) / any_value(t) reg, count(*) filter (n > 0.02 * t) many, max(gap) filter (n > 0.02 * t) parent from o group by 1),
    s as (select k.axis, list(gap order by gap) filter (gap < parent and round(parent / gap) >= 2 and abs(parent / gap - round(parent / gap)) <= 0.05) subs from o join k on o.axis = k.axis where n > 0.02 * t group by 1),
    c as (select k.axis, case when many = 1 then parent when many > 1 and len(subs) > 0 then parent else common end size, case when many > 1 and len(subs) > 0 then subs else [] end subs, reg from k left join s on k.axis = s.axis)
    select d.axis, min(v) as origin, max(v) as "max", any_value(size) as size, cast(round((max(v) - min(v)) / any_value(size)) + 1 as bigint) as "count", (round((max(v) - min(v)) / any_value(size)) + 1) * any_value(size) as extent, any_value(reg) as regularity,
    array_to_string(any_value(subs), ',') as sub_sizes, cast(len(any_value(subs)) as bigint) as sub_count from d join c on d.axis = c.axis group by 1""")
def geometry_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.axes_geometry(block_model(spark, sf_dir), {a: a for a in "xyz"})
    return found.withColumn("sub_sizes", F.array_join(F.transform("sub_sizes", lambda x: x.cast("string")), ","))


@query("""select d as size, n, cast(round(max(d) over () / d) as bigint) as ratio from (select cast(l_linenumber as double) d, count(*) n from lineitem group by 1)""")
def geometry_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.explicit_sizes(block_model(spark, sf_dir), "z")


@query("""with r as (select o_orderkey id, cast(o_custkey as double) x, cast(year(o_orderdate) as double) y from orders order by o_orderkey limit 50000), t as (select sum(cast(x <> lag_x as int)) x, sum(cast(y <> lag_y as int)) y from (select *, lag(x) over (order by id) lag_x, lag(y) over (order by id) lag_y from r))
    select axis, cast(n as bigint) as transitions, cast(row_number() over (order by n desc, axis) as int) as place from (select unnest(['x', 'y']) axis, unnest([x, y]) n from t)""")
def loop_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.year("o_orderdate").cast("double").alias("y"))
    return geometry.loop_order(df, {"x": "x", "y": "y"}, "o_orderkey")


_SWEEP = declustering.Sweep.between(10.0, 130.0, 6, offsets=4)


def _declus_cells(sizes, offsets: int = 4) -> str:
    s = ", ".join(f"cast({x!r} as double)" for x in sizes)
    axis = lambda a: f"floor(({a} - (lo{a} - 0.01 - (k - 1) * least(size / {offsets}, 0.5 * (hi{a} - lo{a})))) / size)"
    return f"""p as (select l_orderkey, l_partkey px, l_suppkey py, cast(l_partkey as double) x, cast(l_suppkey as double) y, l_extendedprice v, row_number() over () rid from lineitem), b as (select min(x) lox, max(x) hix, min(y) loy, max(y) hiy, avg(v) naive, count(*) n from p),
        c as (select rid, v, size, k, {axis('x')} cx, {axis('y')} cy from p, b, (select unnest([{s}]) size), (select unnest(generate_series(1, {offsets})) k))"""


@query(f"""with {_declus_cells(_SWEEP.sizes)} select cast(0 as double) as size, round(naive, 4) as mean from b union all select size, round(avg(m), 4) from (select size, k, avg(m) m from (select size, k, cx, cy, avg(v) m from c group by 1, 2, 3, 4) group by 1, 2) group by 1""")
def declus_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(declustering.curve(block_model(spark, sf_dir), {"x": "x", "y": "y"}, "l_extendedprice", _SWEEP), mean=4)


#: As many sizes and origins as a sweep has by default; y is shorter than two steps between the origins of most sizes.
_WIDE = declustering.Sweep.between(7.3, 900.1, offsets=8)


@query(f"""with {_declus_cells(_WIDE.sizes, 8)} select cast(0 as double) as size, round(naive, 4) as mean from b union all select size, round(avg(m), 4) from (select size, k, avg(m) m from (select size, k, cx, cy, avg(v) m from c group by 1, 2, 3, 4) group by 1, 2) group by 1""")
def declus_curve_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(declustering.curve(block_model(spark, sf_dir), {"x": "x", "y": "y"}, "l_extendedprice", _WIDE), mean=4)


@query(f"""with {_declus_cells(_SWEEP.sizes).replace('l_orderkey, l_partkey px', 'l_orderkey, l_linenumber, l_partkey px')}, m as (select size, avg(m) m from (select size, k, avg(m) m from (select size, k, cx, cy, avg(v) m from c group by 1, 2, 3, 4) group by 1, 2) group by 1),
    w as (select arg_min(size, (m, size)) size from (select size, m from m union all select 0, naive from b)), n as (select c.*, count(*) over (partition by k, cx, cy) cn from c join w on c.size = w.size), f as (select k, count(distinct (cx, cy)) cells from n group by 1)
    select round(weight, 6) as weight, count(*) as n from (select rid, sum(1.0 / cn / cells) * (select n from b) / 4 as weight from n join f using (k) group by rid) group by 1""")
def declus_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by row id at the size of the least mean in the sweep."""
    columns = block_model(spark, sf_dir).select("l_orderkey", "l_linenumber", "x", "y", "l_extendedprice")
    df = with_row_id(columns, ["l_orderkey", "l_linenumber"], "rid").select("rid", "x", "y", "l_extendedprice")
    w = declustering.weights(df, {"x": "x", "y": "y"}, "l_extendedprice", _SWEEP, "rid")
    return w.groupBy(F.round("weight", 6).alias("weight")).agg(F.count("*").alias("n"))



