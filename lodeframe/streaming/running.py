"""Statistics kept up to date over a stream of files or events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.statistics import value_of


def running_moments(stream: DataFrame, variable: str, group: str | None = None) -> DataFrame:
    """([group,] count, sum, mean, std, min, max): additive statistics; use output mode complete or update."""
    v = value_of(variable)
    keys = [F.col(group).alias("group")] if group else []
    return stream.groupBy(*keys).agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def running_counts(stream: DataFrame, column: str) -> DataFrame:
    """(value, n) of a categorical column; use output mode complete or update."""
    return stream.where(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def windowed_moments(stream: DataFrame, time: str, variable: str, width: str = "1 day", delay: str = "1 hour", group: str | None = None) -> DataFrame:
    """Statistics per time window; a window closes, and its state goes, once the watermark has passed it."""
    keys = [F.window(time, width).alias("window"), *([F.col(group).alias("group")] if group else [])]
    v = value_of(variable)
    return stream.withWatermark(time, delay).groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


def upsert(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each trigger's complete result over the last one; the checkpoint makes restarts exact."""
    return result.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
