"""Evidence reports: JSON files with one report per (run, source) and their batch summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.functions import jsonvalue as J

_REPORT = (
    "alias STRING, run_id STRING, started_at STRING, catalog_version STRING, requests_made BIGINT, "
    "stop_reason STRING, "
    "s1_s2 STRUCT<aggregate_state: STRING, capabilities: MAP<STRING, STRUCT<state: STRING>>, "
    "requests: ARRAY<STRUCT<name: STRING, outcome: STRING, error_code: STRING, http_status: INT>>>, "
    "s5_pairs ARRAY<STRUCT<preset_id: STRING, pair_state: STRING, catalog_version: STRING, "
    "preset_version: STRING, applicability: STRUCT<state: STRING, tpu_version: STRING>, "
    "requests: ARRAY<STRUCT<name: STRING, outcome: STRING, error_code: STRING, http_status: INT>>>>"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report file with its content digest."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("report_file"), F.col("value").alias("body")
    )
    digest = J.content_hash(J.canonical_json(F.col("body")))
    return raw.select(
        "report_file", digest.alias("report_sha256"), F.from_json("body", _REPORT).alias("report")
    ).select("report_file", "report_sha256", "report.*")


def capability_attempts(reports: DataFrame) -> DataFrame:
    """One row per report and capability."""
    return reports.select(
        "run_id", "alias", "started_at", "report_sha256",
        F.explode("s1_s2.capabilities").alias("capability", "value"),
    ).select("run_id", "alias", "started_at", "report_sha256", "capability", F.col("value.state").alias("state"))


def pair_attempts(reports: DataFrame) -> DataFrame:
    """One row per report and preset."""
    return reports.select(
        "run_id", "alias", "started_at", "report_sha256", F.explode("s5_pairs").alias("pair")
    ).select(
        "run_id", "alias", "started_at", "report_sha256", "pair.preset_id", "pair.pair_state",
        "pair.catalog_version", "pair.preset_version", F.col("pair.applicability.state").alias("applicability_state"),
        F.col("pair.applicability.tpu_version").alias("tpu_version"),
    )


def report_requests(reports: DataFrame) -> DataFrame:
    """One row per request of a report; ``preset_id`` is NULL for capability requests."""
    capability = reports.select(
        "run_id", "alias", F.lit(None).cast("string").alias("preset_id"), F.explode("s1_s2.requests").alias("q")
    )
    pairs = reports.select("run_id", "alias", F.explode("s5_pairs").alias("pair")).select(
        "run_id", "alias", "pair.preset_id", F.explode("pair.requests").alias("q")
    )
    return capability.unionByName(pairs).select("run_id", "alias", "preset_id", "q.*")


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as newline-delimited JSON files."""
    rows.write.mode("overwrite").json(path)
