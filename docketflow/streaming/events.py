"""Gapless event numbers of each run over many batches.

A batch numbers its own events in their order and starts behind what earlier batches counted for the run. Of those only the
counts are read, one row for each batch and run, never their events. A batch that is committed is not numbered again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.operators import ordered as O
from docketflow.sources import tables as T
from docketflow.streaming import page_stream as S


def append_events(events: DataFrame, batch_key: str, store: S.FactStore, run: str = "run_id", moment: str = "moment", order: Sequence[str] = ("event_id",)) -> None:
    """Store a batch of events with ``event_number``; batches of one run follow each other."""
    spark = events.sparkSession
    if S.is_committed(spark, store, batch_key):
        return
    counts_schema = T.schema_of(f"{run} {events.schema[run].dataType.simpleString()}, n long")
    before = S.facts(spark, store, "event_counts", counts_schema, T.touched_buckets(events, run)).groupBy(run).agg(F.sum("n").alias("__before"))
    numbered = O.running_totals(events, [run], [moment, *order], O.time_bucket(F.col(moment)), {"__number": F.lit(1)})
    rows = numbered.join(before, run, "left").withColumn("event_number", (F.col("__number") + F.coalesce("__before", F.lit(0))).cast("long"))
    T.write_batch(rows.drop("__number", "__before"), store.path("events"), batch_key, run)
    T.write_batch(events.groupBy(run).agg(F.count(F.lit(1)).alias("n")), store.path("event_counts"), batch_key, run)
    S.commit(spark, store, batch_key)


def numbered_events(spark: SparkSession, store: S.FactStore) -> DataFrame:
    return S.facts(spark, store, "events")
