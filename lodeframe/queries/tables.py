"""Queries over datasets: filters, calculated columns, scalar functions, health counters and text round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import categories, drillhole, statistics
from ..plans.dataset import Dataset
from ..plans.storage import shared_dir, tasks_for
from ..sources import paged, sinks, text, zipped
from .registry import block_model, query, rounded, table


@query("""select count(*) as total, count(*) filter (l_quantity > 25 and l_discount >= 0.05) as kept from lineitem""")
def filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(block_model(spark, sf_dir), where="l_quantity > 25 and l_discount >= 0.05").filter_count()


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem where (l_returnflag = 'R' or l_tax > 0.05) and l_shipdate is not null and l_quantity between 10 and 30""")
def filter_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Dataset(block_model(spark, sf_dir), where="l_returnflag = 'R' or l_tax > 0.05").frame("l_shipdate is not null and l_quantity between 10 and 30")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("""select l_returnflag, round(sum(net), 2) as net, round(sum(metal), 4) as metal, count(*) filter (rich = 'rich') as n_rich from (select *, l_extendedprice * (1 - l_discount) net, l_extendedprice * (1 - l_discount) * l_tax metal, case when l_extendedprice * (1 - l_discount) * l_tax > 2000 then 'rich' else 'poor' end rich from lineitem) where rich = 'rich' or l_quantity > 10 group by 1""")
def calcols(spark: SparkSession, sf_dir: str) -> DataFrame:
    calculated = {"net": "l_extendedprice * (1 - l_discount)", "metal": "net * l_tax", "rich": "case when metal > 2000 then 'rich' else 'poor' end"}
    df = Dataset(block_model(spark, sf_dir), calculated, "rich = 'rich' or l_quantity > 10").frame()
    return rounded(df.groupBy("l_returnflag").agg(F.sum("net").alias("net"), F.sum("metal").alias("metal"), F.count_if(F.col("rich") == "rich").alias("n_rich")), net=2, metal=4)


@query("""select 'rows' as check_name, count(*) as n from lineitem union all select 'kept', count(*) filter (l_tax > 0.02) from lineitem union all select 'weight_excluded', count(*) filter (l_tax > 0.02 and l_discount <= 0) from lineitem
    union all select 'empty_columns', cast((count(nullif(l_tax, l_tax)) = 0) as bigint) from lineitem union all select 'coordinates_ignored', count(*) filter (l_linenumber = 7) from lineitem""")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = block_model(spark, sf_dir).withColumns({"z": F.when(F.col("l_linenumber") != 7, F.col("z")), "none": F.lit("")})
    return Dataset(df, where="l_tax > 0.02", weight="l_discount").health(axes={a: a for a in "xyz"})


_V = "(l_extendedprice / 1000 - 50)"


@query(f"""select round(sum(floor({_V} + 0.5)), 4) as rounded, round(sum(floor({_V} * 100 + 0.5) / 100), 4) as rounded_2, round(sum(trunc({_V})), 4) as truncated, round(sum(least(greatest({_V}, -10), 10)), 4) as clamped, round(sum(least({_V}, 5)), 4) as capped,
    round(sum(case when {_V} >= 0 then sqrt({_V}) end), 4) as root, count(*) filter (asin_ok) as arcs, count(*) filter ({_V} between -1 and 1) as inside, round(sum(coalesce(nullif(l_discount, 0), 0.5)), 4) as filled,
    cast(sum(case l_returnflag when 'A' then 1 when 'R' then 2 else 9 end) as bigint) as mapped, round(sum(least(l_discount, l_tax)), 4) as low, round(sum(greatest(l_discount, l_tax)), 4) as high, round(sum(case when l_tax > 0 then ln(l_tax) end), 4) as logs, round(sum(case when l_tax <> 0 then l_discount / l_tax end), 4) as ratio
    from (select *, abs({_V}) <= 1 as asin_ok from lineitem)""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, df = F.col("v"), block_model(spark, sf_dir).withColumn("v", F.col("l_extendedprice") / 1000 - 50)
    d, t = F.col("l_discount"), F.col("l_tax")
    out = df.agg(
        F.sum(scalar.round_half_up(v)).alias("rounded"), F.sum(scalar.round_half_up(v, 2)).alias("rounded_2"), F.sum(scalar.trunc(v)).alias("truncated"),
        F.sum(scalar.clamp(v, -10, 10)).alias("clamped"), F.sum(scalar.cap(v, 5)).alias("capped"), F.sum(scalar.sqrt(v)).alias("root"), F.count(scalar.asin(v)).alias("arcs"),
        F.count_if(scalar.between(v, -1, 1)).alias("inside"), F.sum(scalar.ifnull(F.nullif(d, F.lit(0.0)), 0.5)).alias("filled"),
        F.sum(scalar.remap(F.col("l_returnflag"), {"A": 1, "R": 2}, 9)).alias("mapped"), F.sum(scalar.least_of(d, t)).alias("low"), F.sum(scalar.greatest_of(d, t)).alias("high"),
        F.sum(F.ln(t)).alias("logs"), F.sum(F.try_divide(d, t)).alias("ratio"),
    )
    return rounded(out, **{c: 4 for c in out.columns if c not in ("arcs", "inside", "mapped")})


@query("""select cast(l_orderkey as varchar) || ';' || replace(printf('%.2f', l_extendedprice), '.', ',') || ';' || case when l_returnflag = 'N' then 'NA' else l_returnflag end as "value" from lineitem""")
def text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = block_model(spark, sf_dir).withColumn("flag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    return sinks.text_lines(df, {"l_orderkey": "hole", "l_extendedprice": "price", "flag": "flag"}, sinks.TextFormat(delimiter=";", null="NA", precision=2, decimal=","))


@query("""select count(*) as "rows", count(*) filter (l_linenumber = 7) as ragged_rows, count(*) filter (l_linestatus = 'F') as parse_fails, cast(1 as bigint) as comment_count from lineitem""")
def text_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made from a table, with planted defects, read back as text: a field too many, a number that is none, a comment."""
    li = table(spark, sf_dir, "lineitem")
    number = F.when(F.col("l_linestatus") == "F", F.lit("high")).otherwise(F.col("l_quantity").cast("string"))
    body = li.select(F.concat_ws(",", F.col("l_orderkey").cast("string"), number, "l_returnflag", F.when(F.col("l_linenumber") == 7, F.lit("more"))).alias("value"))
    head = spark.createDataFrame([("# made from lineitem",), ("HOLE,GRADE,ROCK",)], "value string")
    return text.from_lines(head.unionByName(body), ",", {"HOLE": "numeric", "GRADE": "numeric", "ROCK": "categorical"}).counters()


_ROW_ID = "(select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey) - 1 as row_id from lineitem)"


@query(f"""select count(*) as n, min(row_id) as "first", max(row_id) as "last", count(distinct row_id) as "distinct", round(sum(l_extendedprice), 2) as price, count(distinct l_shipdate) as days from {_ROW_ID}""")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.with_row_id(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"])
    out = rows.agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.count_distinct("row_id").alias("distinct"), F.sum("l_extendedprice").alias("price"), F.count_distinct("l_shipdate").alias("days"))
    return rounded(out, price=2)


@query(f"""select row_id, l_orderkey, l_linenumber, l_partkey from {_ROW_ID}""")
def row_id_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_row_id(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"]).select("row_id", "l_orderkey", "l_linenumber", "l_partkey")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as lines of text: quoted clerks with the delimiter in them, prices of one or two decimals."""
    o = table(spark, sf_dir, "orders")
    clerk = F.concat(F.lit('"clerk, ""'), F.col("o_custkey").cast("string"), F.lit('"""'))
    price = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("%.2f", "o_totalprice")).otherwise(F.format_string("%.1f", "o_totalprice"))
    return o.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), clerk, price).alias("value"))


@query("""select cast(o_orderkey as varchar) as "KEY", 'clerk, "' || o_custkey || '"' as "CLERK" from orders""")
def text_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes protect delimiters and are doubled inside."""
    head = spark.createDataFrame([("KEY,CLERK,PRICE",)], "value string")
    return text.parse_quoted(head.unionByName(_lines(spark, sf_dir))).select("KEY", "CLERK")


@query("""select 'KEY' as "column", max(0 * o_orderkey) as decimals from orders union all select 'PRICE', max(length(split_part(case when o_orderkey % 2 = 0 then printf('%.2f', o_totalprice) else printf('%.1f', o_totalprice) end, '.', 2))) from orders""")
def text_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.concat_ws(";", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.format_string("%.2f", "o_totalprice")).otherwise(F.format_string("%.1f", "o_totalprice"))).alias("value"))
    lines = spark.createDataFrame([("KEY;PRICE",)], "value string").unionByName(o)
    return text.decimals(lines, text.from_lines(lines))


@query("""select count(*) > 0 as sampled, true as near from lineitem""")
def filter_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the kept share of a fifth of the rows lies within three points of that of all."""
    d = Dataset(block_model(spark, sf_dir), where="l_quantity > 25 and l_discount >= 0.05")
    both = d.filter_estimate(0.2).crossJoin(F.broadcast(d.filter_count().select(F.col("total").alias("n"), F.col("kept").alias("k"))))  # one row each
    return both.select((F.col("total") > 0).alias("sampled"), (F.abs(F.col("kept_pct") - F.col("k") * 100.0 / F.col("n")) < 3).alias("near"))


@query("""select round(100.0 * count(*) filter (l_quantity > 25) / count(*) * count(*) filter (l_returnflag = 'R') / count(*) * count(*) filter (l_partkey % 2 = 0) / count(*), 6) as expected, true as near from lineitem""")
def filter_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share kept if the columns were independent, and whether the draws come within three standard errors of it; parts are categories by the thousand."""
    rows = block_model(spark, sf_dir).withColumn("part", F.col("l_partkey").cast("string"))
    d = Dataset(rows, {"even": "cast(part as long) % 2 = 0"}, where="l_quantity > 25 and l_returnflag = 'R' and even")
    share = lambda e: F.count_if(F.expr(e)) / F.count("*")
    exact = rows.agg((share("l_quantity > 25") * share("l_returnflag = 'R'") * share("l_partkey % 2 = 0") * 100).alias("expected"))
    both = d.marginal_estimate(["l_quantity"], ["l_returnflag", "part"], 20_000).crossJoin(F.broadcast(exact))  # one row each
    error = F.sqrt(F.col("expected") * (100 - F.col("expected")) / F.col("draws"))
    return rounded(both.select("expected", (F.abs(F.col("kept_pct") - F.col("expected")) < 3 * error).alias("near")), expected=6)


@query("""select 'l_quantty * 2' as expression, 'w: UNRESOLVED_COLUMN.WITH_SUGGESTION: l_quantty; near: l_quantity' as told, cast(null as bigint) as kept union all select 'l_quantity > 25 and l_tax > 0.02', '', count(*) filter (l_quantity > 25 and l_tax > 0.02) from lineitem
    union all select 'l_quantity * 0', '', 0 union all select 'l_shipdat is null', 'w: UNRESOLVED_COLUMN.WITH_SUGGESTION: l_shipdat; near: l_shipdate', null""")
def expression_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with expressions as filters, and how many rows the others keep."""
    li, out = table(spark, sf_dir, "lineitem"), None
    for e in ("l_quantty * 2", "l_quantity > 25 and l_tax > 0.02", "l_quantity * 0", "l_shipdat is null"):
        told = "; ".join(Dataset(li, {"w": e}).problems())
        kept = Dataset(li, where=e).filter_count().select("kept") if not told else spark.range(1).select(F.lit(None).cast("long").alias("kept"))
        row = kept.select(F.lit(e).alias("expression"), F.lit(told.split("; did")[0]).alias("told"), "kept")
        out = row if out is None else out.unionByName(row)
    return out


@query("""select 'dear' as name, 'numeric' as type, count(*) as known from lineitem union all select 'l_orderkey', 'numeric', count(l_orderkey) from lineitem union all select 'l_returnflag', 'categorical', count(nullif(l_returnflag, 'N')) from lineitem union all select 'l_tax', 'categorical', count(l_tax) from lineitem
    union all select 'half', 'numeric', count(*) filter (l_linenumber > 3) from lineitem""")
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of columns and calculated columns, one of them overridden, and how many rows have a value of each."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"), "l_tax", "l_linenumber")
    d = Dataset(df, {"dear": "l_orderkey > 9", "half": "case when l_linenumber > 3 then l_tax / 2 end"}, columns=("l_orderkey", "l_returnflag", "l_tax", "l_linenumber"))
    types = d.column_types({"l_tax": "categorical"})
    wide = d.frame().agg(*[F.struct(F.lit(c).alias("name"), F.lit(t).alias("type"), F.count(c).alias("known")).alias(c) for c, t in types.items() if c != "l_linenumber"])
    return wide.select(F.explode(F.array(*wide.columns)).alias("r")).select("r.*")


@query("""select count(*) filter (l_returnflag <> 'R') as differs, count(*) filter (l_tax is null or l_tax <> 0.02 or l_discount = 0) as differs_or_none, count(*) filter (l_quantity % 7 <> 0) as remainders, round(sum(abs(l_quantity - 25)), 4) as absolute, round(sum(log2(l_quantity)), 4) as log_2, round(sum(log10(l_quantity)), 4) as log_10,
    round(sum(exp(l_discount)), 4) as exponentials, cast(sum(floor(l_extendedprice / 1000)) as bigint) as floors, cast(sum(ceil(l_extendedprice / 1000)) as bigint) as ceilings, cast(sum(sign(l_quantity - 25)) as bigint) as signs, round(sum(power(l_quantity, 1.5)), 2) as powers, count(*) filter (l_tax > 0) as numbers, round(sum(sin(l_quantity) + cos(l_tax) + atan2(l_tax, l_quantity)), 4) as angles from lineitem""")
def scalar_functions_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q, t = block_model(spark, sf_dir), F.col("l_quantity"), F.col("l_tax")
    out = df.agg(
        F.count_if(scalar.differs(F.col("l_returnflag"), "R")).alias("differs"), F.count_if(scalar.differs(F.when(F.col("l_discount") != 0, t), 0.02)).alias("differs_or_none"), F.count_if(F.try_mod(q, F.lit(7)) != 0).alias("remainders"),
        F.sum(F.abs(q - 25)).alias("absolute"), F.sum(F.log2(q)).alias("log_2"), F.sum(F.log10(q)).alias("log_10"), F.sum(F.exp("l_discount")).alias("exponentials"),
        F.sum(scalar.floor(F.col("l_extendedprice") / 1000)).cast("long").alias("floors"), F.sum(scalar.ceil(F.col("l_extendedprice") / 1000)).cast("long").alias("ceilings"), F.sum(F.signum(q - 25)).cast("long").alias("signs"),
        F.sum(scalar.power(q, 1.5)).alias("powers"), F.count_if(scalar.isnum(F.when(t > 0, t).otherwise(F.lit(float("nan"))))).alias("numbers"), F.sum(F.sin(q) + F.cos(t) + F.atan2(t, q)).alias("angles"),
    )
    return rounded(out, absolute=4, log_2=4, log_10=4, exponentials=4, powers=2, angles=4)


def _folder(spark: SparkSession) -> str:
    """A folder of its own among the tables that the cluster shares."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


@query("""select cast(o_orderkey as double) as "KEY", round(o_totalprice, 6) as "PRICE", case when o_orderkey % 5 > 0 then o_orderstatus end as "STATUS", substr('priority ' || o_orderpriority, 1, 16) as "PRIORITY" from orders""")
def paged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as paged binary files by all tasks and read back in ranges of a few pages."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("KEY"), F.col("o_totalprice").alias("PRICE"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("STATUS"), F.concat(F.lit("priority "), "o_orderpriority").alias("PRIORITY"))
    folder = _folder(spark)
    paged.write_paged(rows.repartition(max(3, tasks_for(spark, o.count()))), folder)
    return rounded(paged.read_paged(spark, folder, partition_bytes=1 << 16), PRICE=6)


@query("""select 'PRICE' as name, count(*) as n, round(sum(o_totalprice), 2) as total from orders union all select 'KEY', count(*), sum(o_orderkey) from orders""")
def paged_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a paged file of 4-byte words only the columns that are asked for."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("KEY"), (F.floor("o_totalprice") % 1000).alias("SMALL"), F.col("o_totalprice").alias("PRICE"))
    folder = _folder(spark)
    paged.write_paged(rows.repartition(2), folder)
    back = paged.read_paged(spark, folder, columns=["PRICE", "KEY"])
    wide = back.agg(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.round(F.sum(c), 2).alias("total")).alias(c) for c in back.columns])
    return wide.select(F.explode(F.array(*wide.columns)).alias("r")).select("r.*")


@query("""select cast(o_orderkey as double) as key, round(o_totalprice, 2) as price, case when o_orderstatus <> 'P' then o_orderstatus end as status from orders""")
def zipped_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as zip archives by all tasks and read back as one typed table."""
    o = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    folder = _folder(spark)
    zipped.write_zip(o.repartition(3), folder, {"o_orderkey": "key", "o_totalprice": "price", "o_orderstatus": "status"}, sinks.TextFormat(precision=2, comments=("orders",)))
    return zipped.read_zip(spark, folder, types={"key": "numeric", "price": "numeric", "status": "categorical"}).data()


@query("""select 'li' as part, cast(l_orderkey as varchar) as "KEY", cast(cast(l_quantity as int) * 2 as varchar) as "DOUBLED" from lineitem where l_returnflag = 'R' and l_quantity > 25 union all select 'collar', cast(o_orderkey as varchar), o_orderstatus from orders where o_orderstatus <> 'P'""")
def exported_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset's filtered rows with a calculated column, and a set of raw tables, exported as text and read back."""
    d = Dataset(table(spark, sf_dir, "lineitem"), {"doubled": "l_quantity * 2"}, "l_returnflag = 'R' and l_quantity > 25")
    collars, _ = drillhole.prepared(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), where="o_orderstatus <> 'P'")
    folder = _folder(spark)
    d.export(f"{folder}/li", {"l_orderkey": "KEY", "doubled": "DOUBLED"})
    sinks.write_tables({"collar": collars}, folder)
    li, collar = (text.read_quoted(spark, f"{folder}/{part}") for part in ("li", "collar"))
    return li.select(F.lit("li").alias("part"), "KEY", "DOUBLED").unionByName(collar.toDF("KEY", "DOUBLED").select(F.lit("collar").alias("part"), "KEY", "DOUBLED"))


@query("""with b as (select min(l_partkey) - 5 lx, max(l_partkey) + 5 hx, min(l_suppkey) ly, max(l_suppkey) hy, min(l_quantity) lz, max(l_quantity) hz from lineitem), v as (select x, y, z from b, lateral (select unnest([lx, hx]) x), lateral (select unnest([ly, hy]) y), lateral (select unnest([lz, hz]) z))
    select cast(x as double) as x, cast(y as double) as y, cast(z as double) as z from v""")
def box_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the box around all places as the sink writes them, padded by half a block of 10 along one axis."""
    obj = sinks.bounding_box_obj(table(spark, sf_dir, "lineitem"), {"x": "l_partkey", "y": "l_suppkey", "z": "l_quantity"}, {"x": 10.0})
    return spark.createDataFrame([tuple(map(float, line.split()[1:])) for line in obj.splitlines() if line[0] == "v"], "x double, y double, z double")


@query("""select count(*) as total, count(*) filter (l_discount * 2 > 0.1) as kept, round(sum(l_discount * 2) filter (l_discount * 2 > 0.1), 6) as twice, round(sum(l_discount * 2 * l_quantity) filter (l_discount * 2 > 0.1) / sum(l_quantity) filter (l_discount * 2 > 0.1), 8) as weighed from lineitem""")
def prepared_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drillhole table with a calculated column and a filter, and the same from its recipe as a weighed dataset."""
    li = table(spark, sf_dir, "lineitem")
    rows, counts = drillhole.prepared(li, {"twice": "l_discount * 2"}, "twice > 0.1")
    again = Dataset.from_recipe(li, Dataset(li, {"twice": "l_discount * 2"}, "twice > 0.1", "l_quantity").recipe())
    mean = statistics.moments(again.frame(), ["twice"], again.weight).select(F.col("mean").alias("weighed"))
    sums = rows.agg(F.sum("twice").alias("twice"))
    return rounded(counts.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(mean)), twice=6, weighed=8)  # one row each


@query("""select count(*) filter (starts_with(p_name, 'c')) as begins, count(*) filter (contains(p_name, 'mal')) as holds, count(*) filter (ends_with(p_type, 'Y')) as ends, sum(length(upper(p_name) || lower(p_type))) as lengths, count(distinct substr(p_brand, 7, 2)) as numbers,
    max(replace(trim('  ' || p_type || ' '), 'ECO', '-')) as changed, round(sum(case when p_size % 3 > 0 then p_size else -1.5 end), 4) as known, round(sum(sin(pi() * p_size / 7) + ln(exp(1) * p_size)), 6) as constants from part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of texts, constants, and a default for what is no number."""
    size = F.when(F.col("p_size") % 3 > 0, F.col("p_size")).otherwise(F.lit(float("nan")))
    out = table(spark, sf_dir, "part").agg(
        F.count_if(F.startswith("p_name", F.lit("c"))).alias("begins"), F.count_if(F.contains("p_name", F.lit("mal"))).alias("holds"), F.count_if(F.endswith("p_type", F.lit("Y"))).alias("ends"),
        F.sum(F.length(F.concat(F.upper("p_name"), F.lower("p_type")))).alias("lengths"), F.count_distinct(F.substring("p_brand", 7, 2)).alias("numbers"),
        F.max(F.replace(F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))), F.lit("ECO"), F.lit("-"))).alias("changed"),
        F.sum(scalar.ifnum(size, -1.5)).alias("known"), F.sum(F.sin(F.pi() * F.col("p_size") / 7) + F.ln(F.e() * F.col("p_size"))).alias("constants"),
    )
    return rounded(out, known=4, constants=6)


@query("""with g as (select l_returnflag v, count(*) n, avg(l_quantity) q from lineitem group by 1) select v as "value", n, row_number() over (order by case v when 'R' then 1 when 'A' then 2 else 3 end, n desc, v) as place, round(q, 6) as mean from g""")
def group_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped statistics in a custom order; groups that it does not name follow by falling count."""
    li = table(spark, sf_dir, "lineitem")
    grouped = categories.grouped_statistics(li, ["l_quantity"], "l_returnflag").select(F.col("group").alias("value"), F.col("count").alias("n"), "mean")
    return rounded(categories.with_place(grouped, "custom", ["R", "A"]), mean=6)


@query("""select place, price, weight from (select row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as place, l_extendedprice as price, l_quantity as weight from lineitem) where place <= 100""")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred largest values with their weights, in order."""
    ordered = table(spark, sf_dir, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100)
    return text.numbered(ordered.select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("weight")), "place").withColumn("place", F.col("place") + 1)
