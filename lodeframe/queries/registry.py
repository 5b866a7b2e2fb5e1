"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def block_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a block model: coordinates from part, supplier and line number."""
    xyz = {a: F.col(c).cast("double") for a, c in (("x", "l_partkey"), ("y", "l_suppkey"), ("z", "l_linenumber"))}
    return table(spark, sf_dir, "lineitem").withColumns(xyz)


#: The same view in SQL.
BM = "bm as (select *, cast(l_partkey as double) x, cast(l_suppkey as double) y, cast(l_linenumber as double) z from lineitem)"
