"""Small corpora with the awkward rows every operator must take."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def documents(spark, rows, parts: int = 3):
    """Rows of (doc_id, text) as a documents table."""
    data = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def awkward() -> list[tuple[int | None, str | None]]:
    """Null ids and texts, empty and blank texts, repeated rows, a very long text, odd characters."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (None, "a text without an id, seen once"), (4, "one"), (5, "one two three four five six"),
        (5, "one two three four five six"), (6, "ONE two three four five six"), (7, long_text), (8, long_text + " end"),
        (9, "naïve café \U0001f600 日本語 текст"), (None, None), (10, "line a\nline b\n\nline a"), (-3, "Ünï\x00code\x7f"),
    ]


def with_clashes(docs):
    """Extra columns whose names an operator might use inside."""
    from pyspark.sql import functions as F

    for name in ("row_key", "fp", "part", "word", "words", "n", "key", "shard", "spans", "score", "kept"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs
