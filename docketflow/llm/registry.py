"""Queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketflow.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is the same question as SQL over the given tables."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> None:
    """Import every module that registers queries."""
    from docketflow.llm import (  # noqa: F401
        anchor_dedup, byte_pairs, decontamination, hard_negatives, line_hashes, line_runs, ngram_ratio, ordinal_quality,
        pattern_packing, personal_data, spelling_variants, vector_shards, warc_fixity,
    )
