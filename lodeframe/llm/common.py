"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import checkpoint, shared_dir, small, spare_names

__all__ = ["NO_ID", "WORD", "Vocabulary", "checkpoint", "drop_stored", "id_or_null", "keyed", "mix64", "shared_dir", "slices", "small", "spare_names", "stored"]

#: One word: a run of anything but space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands in for a null id inside an operator, and sorts after every other id.
NO_ID = 2**63 - 1


def stored(df: DataFrame) -> DataFrame:
    """Write a larger intermediate table once, as Parquet in the shared folder, and read it back.

    The shuffle files of this step are deleted with its end, so that the disk of one step does not add to the next one's.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}", spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of tables written by ``stored`` that no later step reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def keyed(df: DataFrame) -> DataFrame:
    """doc_id (null: NO_ID, so that null ids neither vanish from joins nor win a minimum) and text (null: empty)."""
    return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_or_null(column: str):
    return F.when(F.col(column) != NO_ID, F.col(column))


class Vocabulary(dict):
    """Ids for distinct words in order of first sight, with one derived table row per id.

    ``rows(words)`` turns a list of new words into an array with a row for each; only words not
    seen before are derived, so the cost per repeated word is one dictionary lookup.  The table is
    dropped when it holds ``limit`` words, which bounds memory whatever the corpus.
    """

    def __init__(self, rows, limit: int = 250_000):
        super().__init__()
        self._rows, self._limit, self._new, self.table = rows, limit, [], None

    def __missing__(self, word):
        self[word] = n = len(self)
        self._new.append(word)
        return n

    def ids(self, words: list) -> np.ndarray:
        if len(self) > self._limit:
            self.clear()
            self._new, self.table = [], None
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self._new:
            fresh = self._rows(self._new)
            held = self.table[: len(self) - len(self._new)] if self.table is not None else fresh[:0]
            if self.table is None or len(self) > len(self.table):
                grown = np.zeros((max(1024, 2 * len(self)), *fresh.shape[1:]), fresh.dtype)
                grown[: len(held)] = held
                self.table = grown
            self.table[len(held) : len(self)] = fresh
            self._new = []
        return found


def slices(sizes: np.ndarray, limit: int):
    """Runs [i, j) of neighbouring items whose sizes sum to about ``limit``; an item is never split."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
