import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows -> documents table; a row is (doc_id, text[, source[, lang]])."""

    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text, and extra columns with clashing names."""
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000)) + "."
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two three four five six seven."), (4, "One two three four five six seven."), (None, "One two three four five six seven."), (5, "ünï ß 漢字 😀 #$%"), (6, long), (7, long, None, None)]
    df = docs(rows).withColumn("lang", F.when(F.col("doc_id") > 2, F.col("lang")))
    for name in ("size", "score", "fp", "taken", "target", "bin", "rank", "hash", "label", "key", "start", "print"):
        df = df.withColumn(name, F.lit("clash"))
    return df
