"""Streaming jobs over files that Spark derives from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketflow.plans import standins
from docketflow.plans.registry import query
from docketflow.session import ensure_checkpoint_dir
from docketflow.streaming import events, page_stream, repairs, stateful


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _streamed(spark, sf_dir) -> page_stream.FactStore:
    """A store that all event pages went into in two streams and a replay."""
    folder = _folder(spark)
    pages = standins.event_pages(spark, sf_dir)
    for half in (0, 1):
        pages.where(F.col("page_revision") % 2 == half).write.parquet(f"{folder}/pages/half={half}")
    store = page_stream.FactStore(f"{folder}/facts")
    for name in ("half=0", "half=1", ""):
        page_stream.start(spark, f"{folder}/pages/{name}", store, f"{folder}/checkpoint-{name[-1:] or 'replay'}").awaitTermination()
    return store


@query("page_stream_ingest", """SELECT sha256('{"collection_id":"events","previous_checkpoint_revision":' || (event_id // 100) || '}') AS page_key,
  (event_id % 100 + 1)::INT AS hit_ordinal, md5('synthetic' || chr(1) || 'TJGO' || chr(1) || 'u' || user_id) AS representation_id,
  sha256('{"id":"u' || user_id || '","movimentos":[{"codigo":' || json_extract(props, '$.k') || '}],"numeroProcesso":"' || lpad(user_id::VARCHAR, 20, '0')
    || '","tipo":"' || event_type || '","tribunal":"TJGO"}') AS payload_sha256 FROM events""")
def page_stream_ingest(spark, sf_dir):
    """All pages through the stream, those of even number first, then all of them again as a replay."""
    store = _streamed(spark, sf_dir)
    return page_stream.observations(spark, store).select("page_key", "hit_ordinal", "representation_id", "payload_sha256")


@query("stream_movements", """WITH pages AS (SELECT event_id // 100 AS page, max(ts) AS moment FROM events GROUP BY 1),
held AS (SELECT user_id, event_type, json_extract(props, '$.k')::VARCHAR AS k, coalesce(min(moment) FILTER (page % 2 = 0), min(moment)) AS moment FROM events JOIN pages ON event_id // 100 = page GROUP BY 1, 2, 3)
SELECT md5('synthetic' || chr(1) || 'TJGO' || chr(1) || 'u' || user_id) AS representation_id, sha256('{"camposExtras":{},"codigo":' || k || '}') AS content_sha256,
  1::BIGINT AS last_ordinal, strftime(min(moment), '%Y-%m-%d %H:%M:%S') AS first_seen, count(*) AS snapshots FROM held GROUP BY user_id, k""")
def stream_movements(spark, sf_dir):
    """Occurrences of the movements that the stream stored with the pages, and how many snapshots hold each.

    A version keeps the time at which it first arrived, and pages of even number arrive first.
    """
    store = _streamed(spark, sf_dir)
    found = page_stream.occurrences(spark, store).select("representation_id", "content_sha256", "last_ordinal", "first_observed_at")
    held = page_stream.facts(spark, store, "contents").groupBy("representation_id", "content_sha256").agg(F.count("*").alias("snapshots"))
    return found.join(held, ["representation_id", "content_sha256"]).select(
        "representation_id", "content_sha256", "last_ordinal", F.date_format("first_observed_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "snapshots"
    )


@query("stream_coverage", """WITH pages AS (SELECT event_id // 100 AS page, max(ts) AS moment FROM events GROUP BY 1),
seen AS (SELECT *, event_type || json_extract(props, '$.k')::VARCHAR AS content, event_id // 100 AS page FROM events),
placed AS (SELECT s.*, moment, lag(content) OVER (PARTITION BY user_id ORDER BY moment, page, event_id) AS before FROM seen s JOIN pages USING (page)),
outcome AS (SELECT page, user_id, event_id, CASE WHEN before IS NULL THEN 'new' WHEN before <> content THEN 'updated' ELSE 'unchanged' END AS o,
  row_number() OVER (PARTITION BY page, user_id ORDER BY event_id) AS n FROM placed)
SELECT page AS page_revision, count(*) FILTER (o = 'new') AS new, count(*) FILTER (o = 'updated') AS updated, count(*) FILTER (o = 'unchanged') AS unchanged
FROM outcome WHERE n = 1 GROUP BY page""")
def stream_coverage(spark, sf_dir):
    """Per stored page: representations that were new, updated or unchanged."""
    return page_stream.coverage(spark, _streamed(spark, sf_dir)).select("page_revision", "new", "updated", "unchanged")


@query("stream_progress", """WITH pages AS (SELECT event_id // 100 AS page, count(*) AS hits, count(*) FILTER (event_id % 50 = 7) AS bad FROM events GROUP BY 1),
totals AS (SELECT page % 4 AS c, count(*) AS n, sum(hits)::BIGINT AS hits, sum(bad)::BIGINT AS bad, max(page) AS last FROM pages GROUP BY 1)
SELECT 'c' || c AS collection_id, n + (c = 0)::INT AS pages_confirmed, hits AS hits_confirmed, hits - CASE c WHEN 1 THEN 0 ELSE bad END AS valid_hits, CASE c WHEN 1 THEN 0 ELSE bad END AS rejected_hits,
  last + 1 + 4 * (c = 0)::INT AS checkpoint_revision, CASE last % 3 WHEN 0 THEN 10000 WHEN 1 THEN last + 500 END AS source_total, CASE last % 3 WHEN 0 THEN 'gte' END AS total_relation,
  CASE WHEN c = 0 THEN 'exhausted' WHEN hits >= 240 THEN 'limit' ELSE 'running' END AS query_status, CASE WHEN c = 0 AND bad = 0 THEN 'complete' WHEN c = 0 OR hits >= 240 THEN 'partial' END AS coverage FROM totals""")
def stream_progress(spark, sf_dir):
    """Totals and state of four collections by the sums that each batch left, after two streams and a replay.

    One collection ends in an empty page; every fiftieth hit has a bad case number, but for one collection.
    """
    folder = _folder(spark)
    store = page_stream.FactStore(f"{folder}/facts")
    page = F.floor(F.col("event_id") / standins.EVENT_PAGE)
    bad = (F.col("event_id") % 50 == 7) & (page % 4 != 1)
    source = standins.event_source(F.lpad(F.col("user_id").cast("string"), F.when(bad, 19).otherwise(20), F.lit("0")))
    pages = standins.event_pages(spark, sf_dir, source=source).withColumn("collection_id", F.concat(F.lit("c"), F.col("page_revision") % 4))
    end = pages.where("collection_id = 'c0'").groupBy("collection_id").agg(
        (F.max("page_revision") + 4).alias("page_revision"), F.max("responded_at").alias("responded_at"), F.lit("TJGO").alias("tribunal"),
        F.lit("demo").alias("mode"), F.lit('{"hits":{"hits":[]}}').alias("payload"))
    pages = pages.unionByName(end)
    for half in (0, 1):
        pages.where(F.floor(F.col("page_revision") / 4) % 2 == half).write.parquet(f"{folder}/pages/half={half}")
    for name in ("half=0", "half=1", ""):
        page_stream.start(spark, f"{folder}/pages/{name}", store, f"{folder}/checkpoint-{name[-1:] or 'replay'}").awaitTermination()
    return page_stream.collection_progress(spark, store, budget=240)


@query("stream_refusals", """WITH hits AS (SELECT *, event_id // 100 AS page, event_id % 100 + 1 AS ordinal FROM events)
SELECT 'position with other content' AS reason, sha256('{"collection_id":"events","previous_checkpoint_revision":' || page || '}') || ':' || ordinal AS subject FROM hits WHERE event_type = 'view'
UNION ALL SELECT 'page with another number of hits', sha256('{"collection_id":"events","previous_checkpoint_revision":' || page || '}') FROM hits GROUP BY page HAVING page % 2 = 0""")
def stream_refusals(spark, sf_dir):
    """What a replay of all pages is refused for when views have changed and every other page has one hit more."""
    store = _streamed(spark, sf_dir)
    pages = standins.event_pages(spark, sf_dir)
    changed = pages.withColumn("payload", F.replace("payload", F.lit('"tipo":"view"'), F.lit('"tipo":"seen"')))
    extra = F.lit(',{"_id":"extra","sort":[9,"z"],"_source":{"id":"extra","numeroProcesso":"99999999999999999999","tribunal":"TJGO"}}]}}')
    longer = F.when(F.col("page_revision") % 2 == 0, F.concat(F.expr("left(payload, length(payload) - 3)"), extra)).otherwise(F.col("payload"))
    return page_stream.check_batch(changed.withColumn("payload", longer), store)


#: The sort that the cursor pages are approved under.
APPROVED = ("asc", "asc")


def _cursor_pages(spark, sf_dir, tampered: bool):
    """Event pages of four collections in the order of event ids; ``tampered`` ones break the cursor contract in three ways."""
    page, place = F.floor(F.col("event_id") / standins.EVENT_PAGE), F.col("event_id") % standins.EVENT_PAGE
    sort = F.concat(F.col("event_id"), F.lit(',"e'), F.col("event_id"), F.lit('"'))
    if tampered:
        before = (page - 3) * standins.EVENT_PAGE - 1
        sort = (
            F.when((page % 11 == 5) & (place == 1), F.concat(F.lit('"x",'), F.lit('"e"')))
            .when((page % 13 == 6) & (place == 2), F.col("event_id").cast("string"))
            .when((page % 7 == 3) & (place == 0), F.concat(before, F.lit(',"e'), before, F.lit('"')))
            .otherwise(sort)
        )
    pages = standins.event_pages(spark, sf_dir, sort=sort)
    return pages.withColumn("collection_id", F.concat(F.lit("c"), F.col("page_revision") % 4))


@query("stream_cursor", """WITH hits AS (SELECT event_id // 100 AS page, event_id % 100 AS place FROM events WHERE event_id // 400 % 2 = 1),
inside AS (SELECT page, min(place) AS place FROM hits WHERE page % 11 = 5 AND place = 1 OR page % 13 = 6 AND place = 2 GROUP BY page),
broken AS (SELECT page, place, CASE place WHEN 1 THEN 'cursor value of another type' ELSE 'cursor with another number of sort values' END AS reason FROM inside
  UNION ALL SELECT page, 0, 'cursor repeated or went back' FROM hits WHERE page % 7 = 3 AND place = 0 AND page NOT IN (SELECT page FROM inside))
SELECT reason, sha256('{"collection_id":"c' || page % 4 || '","previous_checkpoint_revision":' || page || '}') || ':' || (place + 1) AS subject FROM broken""")
def stream_cursor(spark, sf_dir):
    """Cursor breaks of every second page of each collection, beside the stored pages before and after it.

    The stored half goes through the stream under the same contract; it is sound. The other half repeats the last cursor of a stored page,
    changes the type of a value, or leaves one out.
    """
    folder = _folder(spark)
    store = page_stream.FactStore(f"{folder}/facts")
    late = F.floor(F.col("page_revision") / 4) % 2 == 1
    _cursor_pages(spark, sf_dir, False).where(~late).repartition(3).write.parquet(f"{folder}/pages")
    page_stream.start(spark, f"{folder}/pages", store, f"{folder}/checkpoint", files_per_batch=2, sort=APPROVED).awaitTermination()
    return page_stream.check_batch(_cursor_pages(spark, sf_dir, True).where(late), store, APPROVED)


@query("stream_reprocessed", """WITH pages AS (SELECT event_id // 100 AS page, max(ts) AS moment FROM events GROUP BY 1),
hits AS (SELECT user_id, event_id, page, moment, event_id % 3 = 0 AS bad,
  sha256('{"id":"u' || user_id || '","movimentos":[{"codigo":' || json_extract(props, '$.k') || '}],"numeroProcesso":"' || lpad(user_id::VARCHAR, 20, '0') || '","tipo":"' || event_type || '","tribunal":"TJGO"}') AS sha,
  md5('synthetic' || chr(1) || 'TJGO' || chr(1) || 'u' || user_id) AS rep FROM events JOIN pages ON event_id // 100 = page),
versions AS (SELECT user_id, rep, sha, md5(rep || chr(1) || sha) AS version, coalesce(min(moment) FILTER (NOT bad), min(moment)) AS moment, bool_or(bad) AS mended FROM hits GROUP BY ALL),
current AS (SELECT user_id, sha FROM hits WHERE NOT bad QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY moment DESC, page DESC, event_id DESC) = 1),
stacked AS (SELECT v.*, 1 AS kept FROM versions v JOIN current USING (user_id, sha) UNION ALL SELECT *, 0 FROM versions WHERE mended),
best AS (SELECT * FROM stacked QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY moment DESC, kept DESC, version DESC) = 1)
SELECT rep AS representation_id, b.sha AS payload_sha256, strftime(b.moment, '%Y-%m-%d %H:%M:%S') AS first_seen,
  (SELECT count(*) FROM hits h WHERE h.user_id = b.user_id AND bad) AS repairs, (SELECT count(*) FROM versions v WHERE v.user_id = b.user_id) AS versions FROM best b""")
def stream_reprocessed(spark, sf_dir):
    """Projections after every third hit came with a bad case number and was mended, twice over; repairs and versions by representation."""
    folder = _folder(spark)
    store = page_stream.FactStore(f"{folder}/facts")
    number = F.lpad(F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, 19).otherwise(20), F.lit("0"))
    standins.event_pages(spark, sf_dir, source=standins.event_source(number)).write.parquet(f"{folder}/pages")
    page_stream.start(spark, f"{folder}/pages", store, f"{folder}/checkpoint").awaitTermination()
    mended = page_stream.P.scan_pages(standins.event_pages(spark, sf_dir))
    for batch in ("repair", "the same again"):
        repairs.reprocess(spark, store, batch, mended)
    done = repairs.resolutions(spark, store).groupBy("representation_id").agg(F.count("*").alias("repairs"))
    held = page_stream.facts(spark, store, "versions").groupBy("representation_id").agg(F.count("*").alias("versions"))
    return repairs.projection(spark, store).join(held, "representation_id").join(done, "representation_id", "left").select(
        "representation_id", "payload_sha256", F.date_format("first_observed_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.coalesce("repairs", F.lit(0)).cast("long").alias("repairs"), "versions",
    )


@query("event_numbers", """SELECT user_id AS run_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, ts, event_id) AS event_number FROM events""")
def event_numbers(spark, sf_dir):
    """Events of each user, the run, numbered in three batches; the second batch comes twice."""
    store = page_stream.FactStore(f"{_folder(spark)}/facts")
    rows = standins.read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("moment"), "event_id", "event_type")
    for part in (0, 1, 1, 2):
        events.append_events(rows.where(F.col("event_id") % 3 == part), f"part {part}", store)
    return events.numbered_events(spark, store).select("run_id", "event_id", "event_type", "event_number")


@query("stateful_diff", """WITH daily AS (SELECT user_id, event_type, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT user_id::VARCHAR AS representation_id, event_type AS content_sha256, max(n) AS ordinals FROM daily GROUP BY 1, 2""")
def stateful_diff(spark, sf_dir):
    """Daily snapshots of each user's events as a multiset, reconciled by streaming state."""
    folder = _folder(spark)
    daily = standins.read(spark, sf_dir, "events").groupBy(
        F.col("user_id").cast("string").alias("representation_id"), F.col("event_type").alias("content_sha256"), F.date_trunc("day", "ts").alias("day")
    ).agg(F.count(F.lit(1)).alias("copies"))
    contents = daily.repartitionByRange("day").drop("day")
    contents.write.parquet(f"{folder}/contents")
    stateful.run(spark, f"{folder}/contents", contents.schema, f"{folder}/ranges", f"{folder}/state", files_per_batch=1)
    ranges = spark.read.schema(stateful.RANGE_SCHEMA).parquet(f"{folder}/ranges")
    return ranges.groupBy("representation_id", "content_sha256").agg(
        F.sum(F.col("last_ordinal") - F.col("first_ordinal") + 1).alias("ordinals")
    )
