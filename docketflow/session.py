"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Settings the library relies on; all of them can be set on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated key in a JSON object keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docketflow")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints: the cluster's shared one where it names one.

    A temporary folder is used only when nothing is configured, which is the case in
    single-machine tests.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before checkpointing")
        configured = os.path.join(tempfile.mkdtemp(prefix="docketflow-"), "checkpoints")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder so that lost executors cost no recompute."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def working_folder(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/docketflow-{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: Sequence[str] = (), codec: str | None = None) -> DataFrame:
    """Write rows that several plans read to a Parquet table in the shared folder and read them back.

    Unlike a cache this survives lost executors without recomputing, and later reads take only the
    columns they need, and only the partitions they name. ``codec`` compresses the files; payloads and
    hexadecimal hashes take half the disk with "zstd".
    """
    spark = df.sparkSession
    path = working_folder(spark)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if codec is not None:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
