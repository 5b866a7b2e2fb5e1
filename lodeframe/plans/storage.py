"""Tables cut off from their lineage in the folder that the cluster shares, and joins whose small side is checked."""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers a row is sent to every task.
SMALL_ROWS = 100_000
#: Rows that a task gets of a table dealt by key.
TASK_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if not named and held.isDefined():
        named = held.get()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), f"lodeframe-{os.getpid()}")
    if not held.isDefined():
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The table, computed once; marked for broadcast if it has at most ``rows`` rows, else joined by a shuffle."""
    held = checkpoint(df)
    return F.broadcast(held) if held.limit(rows + 1).count() <= rows else held


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: as many as the cluster has cores, unless rows are very few, and more where tasks would get over ``TASK_ROWS``."""
    return max(1, math.ceil(rows / TASK_ROWS), min(math.ceil(rows / 20_000), spark.sparkContext.defaultParallelism))


def dealt(df: DataFrame, *keys: str, rows: int | None = None, whole: bool = True) -> DataFrame:
    """The table dealt by keys over as many tasks as its rows need, so that a task's memory does not grow with the table.

    Windows and groups by these keys need no other shuffle.  ``rows`` is their number where it is known; else they are counted.  Where it is
    not ``whole``, as not all rows were counted, there are at least as many tasks as shuffles have by default.
    """
    tasks = tasks_for(df.sparkSession, df.count() if rows is None else rows)
    return df.repartition(tasks if whole else max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them, for columns that exist inside an operator only."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
