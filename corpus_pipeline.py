"""A training corpus in five stages: judge quality, drop near-duplicates, decontaminate, mix sources, pack tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import decontamination, grams, mixing, packing, quality, simhash
from lodeframe.llm.common import drop_stored, stored


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores 0.7 or more; labels of rows with crc32(doc_id) mod 4 = 2 stay held out, as in op3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~grams.held_out(4, 2))
    return quality.accepted(docs, quality.fit(docs, labels), 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every component."""
    return simhash.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark item leaks."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins out documents to the sources' target weights."""
    return mixing.mixed_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of 2,048 token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality", judge_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Learned scores, 64-bit hashes and byte-pair tokens have no SQL; tests/llm holds brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
