"""A dataset: a lazy table with its calculated columns, filter and weight, and what they exclude."""

from __future__ import annotations

import difflib
import json
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, truthy
from ..operators.statistics import digest, valid_weight
from ..sources.sinks import TextFormat, write_text
from ..sources.text import TextTable, with_row_id
from .prefix import running_totals
from .sweep import as_of

Expression = str | Column


def column(e: Expression) -> Column:
    return F.expr(e) if isinstance(e, str) else e


@dataclass(frozen=True)
class Dataset:
    """base: the table as read.  calculated: name -> expression, in order; later ones see earlier ones.  where: the global filter.

    Expressions are Spark SQL; a row for which the filter is not true, NULL included, is left out.
    """

    base: DataFrame
    calculated: dict[str, Expression] = field(default_factory=dict)
    where: Expression | None = None
    weight: str | None = None
    columns: tuple[str, ...] | None = None

    def with_calculated(self) -> DataFrame:
        df = self.base if self.columns is None else self.base.select(*self.columns)
        for name, e in self.calculated.items():
            df = df.withColumn(name, column(e))
        return df

    @staticmethod
    def passes(df: DataFrame, e: Expression | None) -> Column:
        """Whether a row passes a filter, by the truth of its value whatever its type; no filter passes all."""
        if e is None:
            return F.lit(True)
        kind = df.select(column(e).alias("c")).dtypes[0][1]
        return truthy(column(e), "boolean" if kind == "boolean" else "string" if kind == "string" else "number")

    def frame(self, local: Expression | None = None) -> DataFrame:
        """Rows that pass the global filter and, after it, a local one."""
        df = self.with_calculated()
        for e in (self.where, local):
            df = df if e is None else df.where(self.passes(df, e))
        return df

    def filter_count(self) -> DataFrame:
        """(total, kept) in one pass."""
        df = self.with_calculated()
        return df.agg(F.count("*").alias("total"), F.count_if(self.passes(df, self.where)).alias("kept"))

    def column_types(self, overrides: dict[str, str] | None = None) -> dict[str, str]:
        """numeric or categorical by each column's type, calculated ones included; numbers and booleans are numeric; overrides win."""
        numbers = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
        return {c: "numeric" if kind in numbers or kind.startswith("decimal") else "categorical" for c, kind in self.with_calculated().dtypes} | (overrides or {})

    def filter_estimate(self, share: float = 0.01, seed: int = 1) -> DataFrame:
        """(total, kept, kept_pct) of a seeded sample of rows."""
        some = replace(self, base=self.base.sample(share, seed)).filter_count()
        return some.withColumn("kept_pct", F.try_divide(F.col("kept") * 100.0, F.col("total")))

    def marginal_estimate(self, numeric: list[str], categorical: list[str], draws: int = 4000, seed: int = 1) -> DataFrame:
        """(draws, kept_pct): share of the filter on rows whose columns are drawn independently from their own distributions.

        A column's distribution is its digest, or the counts of all its categories; missing values are not drawn.  Calculated columns that are not
        listed are computed from what was drawn.  Each draw is a number between 0 and 1 from a hash of seed, column and draw, looked up in the
        cumulative shares as of its place, so a column may have any number of values and reruns agree.
        """
        df = self.with_calculated()
        spark, columns = df.sparkSession, [*numeric, *categorical]
        marks = None
        for k, c in enumerate(columns):
            if c in numeric:
                cells = digest(df, [c]).select(F.col("mean").alias("place"), F.col("weight").alias("c"), F.col("mean").cast("string").alias("value"))
            else:
                counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").cast("double").alias("c"))
                cells = with_row_id(counts, ["value"], "place").withColumn("place", F.col("place").cast("double"))
            # A value is drawn from where the values before it end.
            part = running_totals(cells, [], "place", "c").select(F.lit(k).alias("column"), ((F.col("cum") - F.col("c")) / F.col("total")).alias("at"), "value")
            marks = part if marks is None else marks.unionByName(part)
        drawn = spark.range(draws).withColumn("column", F.explode(F.array(*[F.lit(k) for k in range(len(columns))])))
        drawn = drawn.withColumn("at", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "column", "id"), 11) / F.lit(float(1 << 53)))
        found = as_of(drawn, marks, "column", "at", "value")
        kinds = {f.name: f.dataType for f in df.schema.fields}
        value = lambda k, c: F.max(F.when(F.col("column") == k, F.col("value"))).cast("double" if c in numeric else kinds[c]).alias(c)
        rows = spark.range(draws).join(found.groupBy("id").agg(*[value(k, c) for k, c in enumerate(columns)]), "id", "left")
        for name, e in self.calculated.items():
            if name not in columns:
                rows = rows.withColumn(name, column(e))
        return rows.agg(F.count("*").alias("draws"), (F.count_if(self.passes(rows, self.where)) * 100.0 / F.count("*")).alias("kept_pct"))

    def health(self, source: TextTable | None = None, axes: dict[str, str] | None = None) -> DataFrame:
        """(check_name, n): rows read, kept by the filter and left out by weight, columns without a value, and coordinates without one.

        With the text table that the dataset was read from also values that were no number, ragged rows and comments.
        """
        df = self.with_calculated()
        ok = self.passes(df, self.where)
        types = self.column_types()
        known = {c: finite(F.col(f"`{c}`")) if types[c] == "numeric" else F.when(F.col(f"`{c}`").cast("string") != "", F.lit(1)) for c in df.columns}
        empty = [F.when(F.count(F.when(ok, v)) == 0, 1).otherwise(0) for v in known.values()]
        lost = [F.count_if(finite(F.col(c)).isNull()) for c in (axes or {}).values()]
        wide = df.agg(
            F.count("*").alias("rows"), F.count_if(ok).alias("kept"), F.count_if(ok & valid_weight(self.weight).isNull()).alias("weight_excluded"),
            sum(empty, F.lit(0)).cast("long").alias("empty_columns"), sum(lost, F.lit(0)).cast("long").alias("coordinates_ignored"),
        )
        if source is not None:
            wide = wide.crossJoin(F.broadcast(source.counters().select("parse_fails", "ragged_rows", "comment_count")))  # one row each
        return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("n")) for c in wide.columns])).alias("r")).select("r.*")

    def export(self, path: str, columns: dict[str, str] | None = None, fmt: TextFormat | None = None) -> None:
        """The filtered table with its calculated columns as delimited text."""
        write_text(self.frame(), path, columns, fmt)

    def problems(self) -> list[str]:
        """What Spark's analysis finds wrong with each expression, with near names of unknown columns; no rows are read."""
        found, df = [], self.base
        for name, e in self.calculated.items():
            try:
                df = df.withColumn(name, column(e))
                df.schema
            except AnalysisException as error:
                found.append(self._told(name, error, df))
                return found
        if self.where is not None:
            try:
                df.where(column(self.where)).schema
            except AnalysisException as error:
                found.append(self._told("filter", error, df))
        return found

    @staticmethod
    def _told(name: str, error: AnalysisException, df: DataFrame) -> str:
        unknown = (error.getMessageParameters() or {}).get("objectName", "").strip("`")
        near = difflib.get_close_matches(unknown, df.columns, 3) if unknown else []
        return f"{name}: {error.getCondition() or error}" + (f": {unknown}" if unknown else "") + (f"; near: {', '.join(near)}" if near else "")

    def recipe(self) -> str:
        """The dataset's recipe as JSON, without its data; expressions must be SQL text, as a Column cannot be read back."""
        for name, e in {**self.calculated, "filter": self.where}.items():
            if isinstance(e, Column):
                raise TypeError(f"{name} is a Column; a recipe holds SQL text")
        return json.dumps({"calculated": self.calculated, "where": self.where, "weight": self.weight, "columns": self.columns}, sort_keys=True)

    @staticmethod
    def from_recipe(base: DataFrame, recipe: str) -> "Dataset":
        r = json.loads(recipe)
        return Dataset(base, r["calculated"], r["where"], r["weight"], tuple(r["columns"]) if r["columns"] else None)
