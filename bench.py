"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docketflow.plans import registry  # noqa: E402
from docketflow.session import local_session  # noqa: E402
from docketflow.streaming import page_stream  # noqa: E402

HEADLINE = [
    "overview_stats", "overview_stats_cut", "signal_distribution", "theme_distribution", "facet_subject",
    "process_summaries", "export_rows", "filter_same_representation", "filter_decision_default", "discovery_and",
    "page_scan", "cover_projection", "capture_outcomes", "movement_content", "multiset_ordinals", "snapshot_diff",
    "alteration_match", "publication_swap", "watch_intervals", "decision_history", "rolling_quota", "page_boundaries", "cursor_breaks",
    "evidence_matrix", "percentile_lower", "canonical_hash", "date_status",
    "payload_versions", "latest_projection", "movement_statuses", "rule_evaluation", "news_movements",
    "alteration_counts", "decision_requests", "page_stream_ingest", "stateful_diff",
]

INGEST_HITS = 25_001


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def ingest_pages(spark, folder: str, page_size: int, movements: int = 0) -> None:
    """Pages of unique records in the published benchmark's shape, and the empty page that ends them."""
    moves = ",".join(
        f'{{"codigo":{100 + i},"dataHora":"2026-01-01T10:00:00.000Z","nome":"Movimento {i}"}}' for i in range(movements)
    )
    number = F.col("id")
    stamp = F.date_format(F.timestamp_micros(F.lit(1767225600000000) + number * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    name = F.format_string("benchmark-%05d", number)
    hit = F.concat(
        F.lit('{"_id":"'), name, F.lit('","_source":{"id":"'), name, F.lit('","numeroProcesso":"'),
        F.lpad((number + 1).cast("string"), 20, "0"), F.lit('","tribunal":"TJGO","@timestamp":"'), stamp,
        F.lit(f'","movimentos":[{moves}]}},"sort":["'), stamp, F.lit('","'), name, F.lit('"]}'),
    )
    hits = spark.range(INGEST_HITS).select("id", hit.alias("hit"))
    pages = hits.groupBy(F.floor(number / page_size).alias("page_revision")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "hit"))), lambda h: h["hit"]), ",").alias("hits")
    )
    last = spark.range(1).select(F.lit(-(-INGEST_HITS // page_size)).cast("long").alias("page_revision"), F.lit("").alias("hits"))
    out = pages.unionByName(last).select(
        F.lit("benchmark").alias("collection_id"), "page_revision", F.lit("2026-02-01 00:00:00").cast("timestamp").alias("responded_at"),
        F.lit("TJGO").alias("tribunal"), F.lit("demo").alias("mode"),
        F.concat(F.lit('{"hits":{"total":{"value":10000,"relation":"gte"},"hits":['), "hits", F.lit("]}}")).alias("payload"),
    )
    out.repartition("page_revision").write.parquet(folder)


def ingest(spark, work: str, page_size: int, movements: int = 0) -> dict[str, float]:
    """Seconds of one ingest into an empty store and of its replay."""
    name = f"{work}/p{page_size}m{movements}"
    ingest_pages(spark, f"{name}/pages", page_size, movements)
    store = page_stream.FactStore(f"{name}/facts")
    pages = spark.read.parquet(f"{name}/pages")
    first = timed(lambda: page_stream.ingest_batch(pages, "first", store))
    count = page_stream.observations(spark, store).count()
    replay = timed(lambda: page_stream.ingest_batch(pages, "replay", store))
    again = page_stream.observations(spark, store).count()
    assert count == again == INGEST_HITS, (count, again)
    return {f"ingest_{page_size}_m{movements}": first, f"replay_{page_size}_m{movements}": replay}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_PARTITIONS", "8")), "16g")
    registry.load_all()
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    timed(lambda: registry.QUERIES["overview_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save())
    for name in names:
        seconds[name] = timed(
            lambda: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        )
        print(f"{name:28s} {seconds[name]:7.2f}s", file=sys.stderr, flush=True)
    extra: dict[str, float] = {}
    if not sys.argv[1:]:
        work = tempfile.mkdtemp(prefix="docketflow-bench-")
        for page_size, movements in ((1000, 0), (5000, 0), (10000, 0), (5000, 50)):
            extra.update(ingest(spark, work, page_size, movements))
        for name, value in extra.items():
            print(f"{name:28s} {value:7.2f}s", file=sys.stderr, flush=True)
    rates = {
        name.replace("ingest_", "hits_per_minute_"): round(INGEST_HITS / value * 60)
        for name, value in extra.items() if name.startswith("ingest_")
    }
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {name: round(value, 3) for name, value in {**seconds, **extra}.items()},
        "ingest": rates, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
