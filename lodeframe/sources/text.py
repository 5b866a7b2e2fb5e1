"""Delimited text tables: sniffing, typing and counters of what could not be read."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import COORDINATES, guess_roles
from ..plans.storage import checkpoint, spare_names

# Texts that mean no value in a numeric column, candidates for the delimiter, and the limits of the sample.
SENTINELS = ("", "NA", "NaN", "na", "nan", "N/A", "n/a", "null", "NULL", "*", "-", "-999", "-99", "#N/A", "VOID", "void", "-1.0e+32", "-1e+32", "1e+31", "-9999", "-99999")
DELIMITERS = (",", "\t", ";", "|", " ")
SNIFF_LINES, TYPE_ROWS, KNOWN_VALUES, NUMERIC_SHARE = 20, 100, 20, 0.8
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass
class TextTable:
    """A typed table with what its reading left out.

    frame has a double or string column per header field and the hidden columns __ragged and __failed (names of
    numeric columns whose text was no number).
    """

    frame: DataFrame
    header: list[str]
    types: dict[str, str]
    delimiter: str
    roles: dict[str, str] = field(default_factory=dict)
    comments: DataFrame | None = None

    def data(self) -> DataFrame:
        return self.frame.select(*self.header)

    def counters(self) -> DataFrame:
        """(rows, ragged_rows, parse_fails, comment_count) in one pass over rows, and one over comments."""
        rows = self.frame.agg(F.count("*").alias("rows"), F.count_if("__ragged").alias("ragged_rows"), F.coalesce(F.sum(F.size("__failed")), F.lit(0)).cast("long").alias("parse_fails"))
        return rows.crossJoin(F.broadcast(self.comments.agg(F.count("*").alias("comment_count"))))  # one row each


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that splits all lines alike into most fields; else the one with most fields on the first line; ties go to the earlier candidate."""
    best, most = DELIMITERS[0], 0
    for d in DELIMITERS:
        n = [line.count(d) + 1 for line in lines[:SNIFF_LINES]]
        if not n or n[0] < 2:
            continue
        rank = n[0] * 1000 + len(n) if len(set(n)) == 1 else n[0]
        if rank > most:
            best, most = d, rank
    return best


def bare(text: str) -> str:
    return re.sub(r"^[\"']|[\"']$", "", text.strip())


def column_type(values: list[str]) -> str:
    """numeric or categorical by a column's sample: over 80 % numbers among what is no sentinel, or nothing else."""
    known = [v for v in values if v not in SENTINELS]
    numbers = sum(bool(re.match(NUMBER, v)) for v in known)
    return "numeric" if numbers == len(known) or numbers and numbers / len(known) > NUMERIC_SHARE else "categorical"


def _number(raw: Column) -> Column:
    d = F.when(F.regexp_like(raw, F.lit(NUMBER)), raw.try_cast("double"))
    return F.when(F.abs(d) < float("inf"), d)


def typed(fields: Column, header: list[str], types: dict[str, str]) -> tuple[list[Column], Column]:
    """Columns of the header from an array of bare field texts, and the names of those that failed to parse."""
    columns, failed = [], []
    for i, name in enumerate(header):
        raw = F.get(fields, F.lit(i))
        if types[name] == "numeric":
            held = F.when(raw.isin(*SENTINELS), None).otherwise(_number(raw))
            columns.append(held.alias(name))
            failed.append(F.when(raw.isNotNull() & ~raw.isin(*SENTINELS) & held.isNull(), F.lit(name)))
        else:
            columns.append(F.when(raw != "", raw).alias(name))
    return columns, F.filter(F.array(*failed) if failed else F.array().cast("array<string>"), lambda n: n.isNotNull())


def from_lines(lines: DataFrame, delimiter: str | None = None, types: dict[str, str] | None = None, header: list[str] | None = None, file: str | None = None) -> TextTable:
    """lines(value) -> typed table.  Lines that start with ``#`` are comments, blank lines are skipped, the first other line is the header.

    The header is dropped by its place, so that equal lines further down are rows; with ``file``, a column that names the file of
    a line, every file has a header.  With ``header`` given the table has none and every line is a row.  Fields are split at each delimiter
    (quotes do not protect it), trimmed and freed of one outer quote; a line with another number of fields than the header is ragged.

    A column's type is told by the first ``TYPE_ROWS`` rows; where they hold fewer than ``KNOWN_VALUES`` values of it, one
    aggregate over all rows decides, so that a column that fills up late is not taken for numeric.  ``types`` sets types outright.
    """
    text = F.regexp_replace("value", "\r$", "")
    lines = lines.select(text.alias("value"), *([F.col(file).alias("__file")] if file else []), F.monotonically_increasing_id().alias("__at"))
    body = lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    head = body.select("value", "__at", *(["__file"] if file else [])).limit(TYPE_ROWS + 1).collect()
    if not head:
        raise ValueError("the table has no header line")
    if file:  # the headers of further files are no values
        head.sort(key=lambda r: r["__at"])
        opens = {r["__file"]: k for k, r in reversed(list(enumerate(head)))}
        head = [r for k, r in enumerate(head) if k == 0 or opens[r["__file"]] != k]
    first = [r["value"] for r in head]
    delimiter = delimiter or sniff_delimiter(first)
    names = header or [bare(f) for f in first[0].split(delimiter)]
    fields = F.transform(F.split("value", re.escape(delimiter), -1), lambda f: F.regexp_replace(F.trim(f), "^[\"']|[\"']$", ""))
    if header:
        rows = body
    elif file:
        rows = body.join(body.groupBy("__file").agg(F.min("__at").alias("__at")).select("__at"), "__at", "left_anti")
    else:
        rows = body.where(F.col("__at") != head[0]["__at"])
    rows = rows.select(fields.alias("__f"))
    sample = [[bare(f) for f in line.split(delimiter)] for line in (first if header else first[1:])]
    values = {n: [row[i] for row in sample if i < len(row)] for i, n in enumerate(names)}
    found = {n: column_type(v) for n, v in values.items()} | (types or {})
    late = [n for n, v in values.items() if n not in (types or {}) and sum(x not in SENTINELS for x in v) < KNOWN_VALUES]
    if late and len(first) > TYPE_ROWS:
        found |= _types_by_all_rows(rows, names, late)
    columns, failed = typed(F.col("__f"), names, found)
    frame = rows.select(*columns, (F.size("__f") != len(names)).alias("__ragged"), failed.alias("__failed"))
    return TextTable(frame, names, found, delimiter, guess_roles([n for n in names if found[n] == "numeric"], COORDINATES), lines.where(F.startswith("value", F.lit("#"))))


def _types_by_all_rows(rows: DataFrame, names: list[str], wanted: list[str]) -> dict[str, str]:
    """Types of some columns by the share of numbers among all their values, in one aggregate."""
    counts = []
    for k, n in enumerate(wanted):
        raw = F.get("__f", F.lit(names.index(n)))
        known = raw.isNotNull() & ~raw.isin(*SENTINELS)
        counts += [F.count_if(known).alias(f"k{k}"), F.count_if(known & F.regexp_like(raw, F.lit(NUMBER))).alias(f"n{k}")]
    got = rows.agg(*counts).first()
    return {n: "numeric" if got[f"n{k}"] == got[f"k{k}"] or got[f"n{k}"] > NUMERIC_SHARE * got[f"k{k}"] else "categorical" for k, n in enumerate(wanted)}


def read_text(spark: SparkSession, path: str, **options) -> TextTable:
    """A delimited text file, or a folder of files that each begin with the header, as a typed table."""
    return from_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")), file="file", **options)


def read_quoted(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A text table whose quotes protect delimiters and are doubled inside, all columns text."""
    return spark.read.csv(path, sep=delimiter, header=True, quote='"', escape='"', comment="#", mode="PERMISSIVE")


def parse_quoted(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """The same for lines(value), such as those of an archive's member; the first line that is no comment is the header."""
    lines = lines.select(F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("at"))
    body = lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    head = body.first()
    if head is None:
        raise ValueError("the table has no header line")
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    names = next(csv.reader([head["value"]], delimiter=delimiter, quotechar='"'))
    schema = ", ".join(f"`{n.strip().replace('`', '``')}` string" for n in names)
    return body.where(F.col("at") != head["at"]).select(F.from_csv("value", schema, options).alias("r")).select("r.*")


def decimals(lines: DataFrame, table: TextTable) -> DataFrame:
    """(column, decimals): most digits after the point in each numeric column."""
    text = F.split("value", re.escape(table.delimiter), -1)
    body = lines.where(~F.startswith("value", F.lit("#")))
    digits = [F.max(F.length(F.regexp_extract(F.trim(F.get(text, F.lit(i))), r"^[+-]?\d*\.(\d+)$", 1))).alias(f"__{i}") for i, n in enumerate(table.header) if table.types[n] == "numeric"]
    wide = body.agg(*digits) if digits else None
    pairs = [F.struct(F.lit(n).alias("column"), F.coalesce(F.col(f"__{i}"), F.lit(0)).alias("decimals")) for i, n in enumerate(table.header) if table.types[n] == "numeric"]
    return wide.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """A dense row number from 0 by an order of columns, for operators that join computed weights back.

    Rows that are equal in ``order`` go by a hash of all columns, so reruns agree and only rows equal throughout change places.  The table
    is dealt by ranges of that order and sorted in each; ``numbered`` makes the numbers.
    """
    (tie,) = spare_names(df, "tie")
    hashable = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    ranged = df.withColumn(tie, F.xxhash64(*hashable)).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    return numbered(ranged.drop(tie), name)


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Rows of a table whose partitions are sorted one after the other, as after ``orderBy``, with a dense number from 0.

    The table is written to a checkpoint with each row's range and place; numbers are made from what was written, so ranges that are sampled
    anew when something is computed again cannot mix.  A row per range is sent to all tasks.
    """
    at, part, before = spare_names(ordered, "at", "part", "before")
    # monotonically_increasing_id holds the partition above 33 bits of the place in it.
    placed = checkpoint(ordered.withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(part, F.coalesce(ahead, F.lit(0)).alias(before))
    return placed.join(F.broadcast(sizes), part).withColumn(name, F.col(before) + F.col(at)).select(*[c for c in ordered.columns if c != name], name)
