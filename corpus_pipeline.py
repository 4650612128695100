"""The corpus pipeline: quality, repeated lines, near-duplicates, benchmark matches, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm import anchor_dedup, decontamination, line_runs, ordinal_quality, pattern_packing
from docketflow.llm.registry import table
from docketflow.llm.rows import free_name
from docketflow.session import configure, ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade reaches the bar."""
    model = ordinal_quality.trained(docs, ordinal_quality.grades_of(table(spark, sf_dir, "labels")))
    return ordinal_quality.accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated line runs; ``n_chars``, where there is such a column, follows the text."""
    cut = free_name(docs, "_lines")
    out = line_runs.without_later_copies(docs, out=cut)
    if "n_chars" in docs.columns:
        size = F.when(F.col(cut)["n_removed"] > 0, F.length(F.col(cut)["text"])).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col(cut)["text"]).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree to about four fifths or more."""
    return anchor_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences."""
    return pattern_packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packing),
]

#: Training, prefix doubling, fingerprints and tokens have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's rows are written to the shared folder."""
    configure(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
