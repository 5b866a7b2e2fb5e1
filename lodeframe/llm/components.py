"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node long, root long) for every node that is not the smallest of its component.

    The minimum over a node's neighbours is a partially aggregated groupBy, written to a checkpoint and joined back: between two
    tables as they lie, so that few minima are sent to all tasks and the many edges of a hub can be split among several.
    Each round is checkpointed; only counts and a checksum of the edges reach the driver.  An empty edge table gives an empty result.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = checkpoint(tidy(edges))
    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = small(both.groupBy("a").agg(F.min("b").alias("low")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        large = checkpoint(tidy(large))
        least = small(large.groupBy("a").agg(F.min("b").alias("low")))
        near = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = checkpoint(tidy(near.union(least.select("a", F.col("low").alias("b")))))
        before, seen = seen, state(now)
        if seen == before:
            break
    else:
        raise RuntimeError("connected_components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
