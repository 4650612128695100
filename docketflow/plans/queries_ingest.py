"""Pages and hits through validation, quarantine, versions and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.functions import dates as D
from docketflow.functions import jsonvalue as J
from docketflow.functions import text as X
from docketflow.operators import collection as L
from docketflow.operators import movements as M
from docketflow.operators import ordered as O
from docketflow.operators import reconcile as R
from docketflow.plans import ingest, standins
from docketflow.plans.registry import query
from docketflow.plans.sqlparts import HITS
from docketflow.session import stored
from docketflow.sources import pages as P
from docketflow.sources import tables as T

_WITH = f"WITH {HITS}"


def _prepared(spark, sf_dir):
    return ingest.prepare_hits(standins.line_hits(spark, sf_dir))


def _facts(spark, sf_dir, *more):
    """What observations are made of, and ``more`` columns, as a written table, for plans that read them more than once."""
    valid = ingest.valid_hits(_prepared(spark, sf_dir))
    return stored(valid.select(*dict.fromkeys([*ingest.OBSERVED, *more])), codec="zstd")


def _day(column):
    return F.date_format(column, "yyyy-MM-dd")


@query("page_scan", """SELECT event_id // 100 AS page_revision, (event_id % 100 + 1)::INT AS hit_ordinal, 'u' || user_id AS hit_id,
  sha256('{"collection_id":"events","previous_checkpoint_revision":' || (event_id // 100) || '}') AS page_key FROM events""")
def page_scan(spark, sf_dir):
    """Hits of all page envelopes with their position."""
    hits = P.scan_pages(standins.event_pages(spark, sf_dir))
    hit = F.try_parse_json("hit")
    return hits.select("page_revision", "hit_ordinal", J.text_at(hit, "$._id").alias("hit_id"), "page_key")


@query("page_totals", """WITH pages AS (SELECT event_id // 100 AS page_revision, count(*) AS hits FROM events GROUP BY 1)
SELECT page_revision, hits,
  CASE page_revision % 3 WHEN 0 THEN 10000 WHEN 1 THEN page_revision + 500 END AS total_value,
  CASE page_revision % 3 WHEN 0 THEN 'lower_bound' WHEN 1 THEN 'exact' ELSE 'unknown' END AS total_kind,
  CASE WHEN page_revision % 3 = 1 THEN least(100, floor(hits * 100 / (page_revision + 500)))::BIGINT END AS percent
FROM pages""")
def page_totals(spark, sf_dir):
    """Source totals: exact, lower bound or unknown, and a percentage for exact ones only."""
    enveloped = P.with_envelope(standins.event_pages(spark, sf_dir)).where("page_error IS NULL")
    hits = F.size("hit_texts").cast("long")
    return enveloped.select(
        "page_revision", hits.alias("hits"), "total_value", "total_kind",
        X.exact_percent(hits, F.col("total_value"), F.col("total_kind")).alias("percent"),
    )


@query("page_contract", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber WHEN 1 THEN 'ENVELOPE_NOT_OBJECT' WHEN 2 THEN 'HITS_NOT_OBJECT' WHEN 3 THEN 'HITS_NOT_ARRAY'
    WHEN 4 THEN 'HIT_NOT_SOUND' WHEN 5 THEN 'HIT_NOT_SOUND' WHEN 6 THEN 'TOTAL_INVALID' END AS page_error FROM lineitem""")
def page_contract(spark, sf_dir):
    """Which envelopes break the contract, one page per line item."""
    body = (
        F.when(F.col("l_linenumber") == 1, F.lit("[]"))
        .when(F.col("l_linenumber") == 2, F.lit('{"hits":3}'))
        .when(F.col("l_linenumber") == 3, F.lit('{"hits":{"hits":{}}}'))
        .when(F.col("l_linenumber") == 4, F.lit('{"hits":{"hits":[{"_id":"a","sort":[]}]}}'))
        .when(F.col("l_linenumber") == 5, F.lit('{"hits":{"hits":[{"_id":"a","sort":[1]},{"_id":"b","sort":[{}]}]}}'))
        .when(F.col("l_linenumber") == 6, F.lit('{"hits":{"total":true,"hits":[]}}'))
        .otherwise(F.concat(F.lit('{"hits":{"total":{"value":1,"relation":"eq"},"hits":[{"sort":[1.5,"x",null],"_id":"'), F.col("l_partkey"), F.lit('"}]}}')))
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    pages = standins.read(spark, sf_dir, "lineitem").select(*keys, body.alias("payload"))
    return P.with_envelope(pages).select(*keys, "page_error")


@query("cover_projection", f"""{_WITH} SELECT representation_id, version_id, lpad(l_orderkey::VARCHAR, 20, '0') AS process_number,
  payload_sha256, l_suppkey::VARCHAR AS class_code, 'Flag ' || l_returnflag AS class_name, l_linestatus AS grau,
  l_partkey::VARCHAR AS court_unit_code, NULL::VARCHAR AS court_unit_name, filed AS filed_original,
  CASE WHEN l_linestatus = 'F' THEN day || 'T03:00:00' END AS filed_at, l_linestatus <> 'F' AS filed_ambiguous,
  day || 'T00:00:00' AS updated_at FROM sound""")
def cover_projection(spark, sf_dir):
    """The projected cover of every valid hit with the hash of its payload."""
    text = "yyyy-MM-dd'T'HH:mm:ss"
    return ingest.valid_hits(_prepared(spark, sf_dir)).select(
        "representation_id", "version_id", "process_number", "payload_sha256", "class_code", "class_name", "grau",
        "court_unit_code", "court_unit_name", "filed_original", F.date_format("filed_at", text).alias("filed_at"),
        "filed_ambiguous", F.date_format("updated_at", text).alias("updated_at"),
    )


@query("cover_quarantine", f"""{_WITH} SELECT collection_id, page_key, l_linenumber AS hit_ordinal, error_path, validation_code
FROM hits WHERE validation_code IS NOT NULL""")
def cover_quarantine(spark, sf_dir):
    """Rejected hits with the first failing check."""
    return ingest.cover_rejections(_prepared(spark, sf_dir)).select(*ingest.POSITION, "error_path", "validation_code")


@query("cover_subjects", f"""{_WITH} SELECT version_id, 1 AS ordinal, part::VARCHAR AS subject_code, 'Part ' || part AS subject_name FROM versions
UNION ALL SELECT version_id, 2, NULL, flag FROM versions""")
def cover_subjects(spark, sf_dir):
    """Subjects of every version, numbered without the empty ones."""
    valid = ingest.valid_hits(_prepared(spark, sf_dir))
    kept = ingest.versions(valid.select(*ingest.VERSION_KEYS, "payload", *ingest.OBSERVATION_ORDER))
    return ingest.subjects(kept).select("version_id", "ordinal", "subject_code", "subject_name")


@query("payload_versions", f"""{_WITH} SELECT representation_id, version_id, payload_sha256, strftime(first_at, '%Y-%m-%d') AS first_day FROM versions""")
def payload_versions(spark, sf_dir):
    """Content-addressed versions with their first observation."""
    valid = ingest.valid_hits(_prepared(spark, sf_dir))
    kept = ingest.versions(valid.select(*ingest.VERSION_KEYS, *ingest.OBSERVATION_ORDER))
    return kept.select("representation_id", "version_id", "payload_sha256", _day("first_observed_at").alias("first_day"))


_OBSERVED = f"""{_WITH}, observed AS (
  SELECT *, lag(payload_sha256) OVER w AS prev_hash, lag(l_linestatus) OVER w AS prev_status, lag(l_shipdate) OVER w AS prev_ship,
    CASE WHEN prev_hash IS NULL THEN 'new' WHEN prev_hash <> payload_sha256 THEN 'updated' ELSE 'unchanged' END AS capture_outcome,
    coalesce(prev_status = l_linestatus AND l_shipdate < prev_ship, false) AS filed_regressed
  FROM sound WINDOW w AS (PARTITION BY representation_id ORDER BY observed_order, collection_id, l_partkey, l_linenumber))"""


@query("capture_outcomes", _OBSERVED.replace("observed_order", "l_shipdate") + """
SELECT collection_id, page_key, l_linenumber AS hit_ordinal, representation_id, capture_outcome, filed_regressed FROM observed""")
def capture_outcomes(spark, sf_dir):
    """New, updated or unchanged for every observation, and filing dates that went back."""
    seen = ingest.observations(_facts(spark, sf_dir))
    return seen.select(*ingest.POSITION, "representation_id", "capture_outcome", "filed_regressed")


@query("date_regression", f"""{_WITH}, log AS (
  SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day, event_type = 'view' AS aware,
    timestamp '2024-01-01' + to_days((value * 100)::BIGINT % 400) AS filed FROM events),
chained AS (SELECT *, lag(filed) OVER w AS before, lag(aware) OVER w AS was_aware FROM log
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, coalesce(aware = was_aware AND filed < before, false) AS regressed FROM chained""".replace(f"{_WITH}, ", "WITH "))
def date_regression(spark, sf_dir):
    """Source dates that go back along a user's events; texts with and without zone do not compare."""
    events = standins.read(spark, sf_dir, "events")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.round(F.col("value") * 100).cast("long") % 400).cast("int"))
    text = F.concat(day.cast("string"), F.when(F.col("event_type") == "view", "T00:00:00Z").otherwise("T00:00:00"))
    log = events.select("user_id", "event_id", "ts", text.alias("filed_original"))
    chained = O.previous_values(log, ["user_id"], ["event_id"], O.number_bucket(F.col("event_id"), 5000), ["filed_original"])
    return chained.select(
        "event_id", D.regressed(F.col("prev_filed_original"), F.col("filed_original")).alias("regressed")
    )


@query("latest_projection", f"""{_WITH} SELECT representation_id, version_id AS latest_version_id, l_suppkey::VARCHAR AS class_code,
  strftime(l_shipdate, '%Y-%m-%d') AS last_day FROM sound
QUALIFY row_number() OVER (PARTITION BY representation_id ORDER BY l_shipdate DESC, collection_id DESC, l_partkey DESC, l_linenumber DESC) = 1""")
def latest_projection(spark, sf_dir):
    """The current state of every representation."""
    valid = _facts(spark, sf_dir, "class_code")
    out = ingest.representations(ingest.observations(valid), ingest.versions(valid))
    return out.select("representation_id", "latest_version_id", "class_code", _day("last_observed_at").alias("last_day"))


@query("collection_inclusions", _OBSERVED.replace("observed_order", "l_shipdate") + """
SELECT collection_id, representation_id, capture_outcome, strftime(l_shipdate, '%Y-%m-%d') AS included_day FROM observed
QUALIFY row_number() OVER (PARTITION BY collection_id, representation_id ORDER BY l_partkey, l_linenumber, l_shipdate) = 1""")
def collection_inclusions(spark, sf_dir):
    """The first inclusion of each representation in each collection."""
    seen = ingest.observations(_facts(spark, sf_dir))
    return ingest.collection_results(seen).select(
        "collection_id", "representation_id", "capture_outcome", _day("included_at").alias("included_day")
    )


@query("latest_per_key", """SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(spark, sf_dir):
    """The last event of every user."""
    events = standins.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return O.latest(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("lateral_latest", """SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN LATERAL (
  SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true""")
def lateral_latest(spark, sf_dir):
    """Every customer with the latest order, customers without any included."""
    last = O.latest(
        standins.read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"),
        ["o_custkey"], ["o_orderdate", "o_orderkey"],
    )
    customers = standins.read(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query("insert_if_absent", """SELECT l_orderkey, l_linenumber, min(l_shipdate::DATE) AS first_shipped FROM lineitem
WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')
GROUP BY 1, 2""")
def insert_if_absent(spark, sf_dir):
    """Rows a batch adds to a table that already holds the returned line items."""
    line = standins.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.to_date("l_shipdate").alias("first_shipped")
    )
    added = T.new_rows(line, line.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"], ["first_shipped", "l_returnflag"])
    return added.select("l_orderkey", "l_linenumber", "first_shipped")


@query("hash_collision_check", """WITH h AS (SELECT sha256(CASE WHEN source IN ('src0', 'src7') THEN source || lang ELSE text END) AS hash, sha256(text) AS full_hash FROM documents)
SELECT hash FROM h GROUP BY hash HAVING count(DISTINCT full_hash) > 1""")
def hash_collision_check(spark, sf_dir):
    """Full hashes that stand for more than one text: two sources hash a label in place of the text."""
    planted = F.when(F.col("source").isin("src0", "src7"), F.concat("source", "lang")).otherwise(F.col("text"))
    texts = standins.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content"), F.sha2(planted, 256).alias("hash"))
    return R.hash_collisions(texts, "hash", "content")


@query("origin_conflicts", """SELECT l_suppkey::VARCHAR AS source_id FROM lineitem GROUP BY l_suppkey
HAVING count(DISTINCT l_orderkey) > 1""")
def origin_conflicts(spark, sf_dir):
    """Origins linked to more than one case number."""
    rows = standins.read(spark, sf_dir, "lineitem").select(
        F.lit("registry").alias("source"), F.lit("TJGO").alias("tribunal"), F.col("l_suppkey").cast("string").alias("source_id"),
        F.lpad(F.col("l_orderkey").cast("string"), 20, "0").alias("process_number"),
    )
    return ingest.origin_conflicts(rows).select("source_id")


@query("replay_conflicts", """SELECT DISTINCT a.l_orderkey AS order_key, a.l_linenumber AS line FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_returnflag = 'R' AND b.l_returnflag = 'A'
WHERE a.l_partkey <> b.l_partkey""")
def replay_conflicts(spark, sf_dir):
    """Positions replayed with other content, each named once."""
    line = standins.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("collection_id"), F.lit("p").alias("page_key"), F.col("l_linenumber").alias("hit_ordinal"),
        "l_partkey", "l_returnflag",
    )
    # Each side is made distinct first, so a position with many rows stays small.
    keys = [*ingest.POSITION, "l_partkey"]
    batch = line.where("l_returnflag = 'R'").select(*keys).distinct()
    stored = line.where("l_returnflag = 'A'").select(*keys).distinct()
    return ingest.replay_conflicts(batch, stored, "l_partkey").select(
        F.col("collection_id").alias("order_key"), F.col("hit_ordinal").alias("line")
    ).distinct()


@query("replay_gaps", """WITH pages AS (SELECT event_id // 100 AS page_key, count(*) AS hits FROM events GROUP BY 1),
stored AS (SELECT DISTINCT event_id // 100 AS page_key, event_id % 100 + 1 AS p FROM events WHERE event_type <> 'error'
  UNION SELECT DISTINCT event_id // 100, event_id % 100 + 1 FROM events WHERE value > 50)
SELECT page_key, any_value(hits) AS hits FROM pages JOIN stored USING (page_key) GROUP BY page_key
HAVING count(*) <> any_value(hits) OR min(p) <> 1 OR max(p) <> any_value(hits)""")
def replay_gaps(spark, sf_dir):
    """Pages whose observed and rejected positions together do not cover the page."""
    events = standins.read(spark, sf_dir, "events").withColumns(
        {"page_key": F.floor(F.col("event_id") / 100), "hit_ordinal": F.col("event_id") % 100 + 1}
    )
    observed = events.where("event_type <> 'error'").select("page_key", "hit_ordinal")
    rejected = events.where("value > 50").select("page_key", "hit_ordinal")
    sizes = events.groupBy("page_key").agg(F.count(F.lit(1)).alias("hits"))
    return ingest.replay_gaps(observed.unionByName(rejected), sizes).select("page_key", "hits")


_PAGE_EVENTS = """WITH log AS (SELECT *, event_id // 100 AS page, event_id % 100 + 1 AS pos,
    sha256(user_id || event_type) AS h FROM events),
seen AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM log),
judged AS (SELECT *, CASE WHEN before IS NULL THEN 'new' WHEN before <> event_type THEN 'updated' ELSE 'unchanged' END AS outcome FROM seen),
firsts AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY page, user_id ORDER BY pos) = 1)"""


def _page_events(spark, sf_dir):
    events = standins.read(spark, sf_dir, "events").select(
        F.lit("events").alias("collection_id"), F.floor(F.col("event_id") / 100).alias("page_revision"),
        (F.col("event_id") % 100 + 1).alias("hit_ordinal"), "user_id", "event_type", "event_id", "value", "ts",
    )
    return events.withColumn("page_key", F.col("page_revision").cast("string"))


def _page_observations(spark, sf_dir):
    chained = O.previous_values(
        _page_events(spark, sf_dir), ["user_id"], ["event_id"], O.number_bucket(F.col("event_id"), 5000), ["event_type"]
    )
    outcome = (
        F.when(~F.col("prev_exists"), "new").when(F.col("prev_event_type") != F.col("event_type"), "updated")
        .otherwise("unchanged")
    )
    return chained.withColumn("capture_outcome", outcome).withColumnRenamed("user_id", "representation_id")


@query("page_outcome_counts", _PAGE_EVENTS + """
SELECT page AS page_revision, count(*) FILTER (outcome = 'new') AS new, count(*) FILTER (outcome = 'updated') AS updated,
  count(*) FILTER (outcome = 'unchanged') AS unchanged FROM firsts GROUP BY page""")
def page_outcome_counts(spark, sf_dir):
    """Distinct representations per page by the outcome of their first hit."""
    return ingest.page_counts(_page_observations(spark, sf_dir)).select("page_revision", "new", "updated", "unchanged")


@query("page_coverage", _PAGE_EVENTS + """,
pages AS (SELECT event_type AS collection_id, page, count(*) AS hits, count(*) FILTER (value < 5) AS rejected FROM log GROUP BY 1, 2)
SELECT collection_id, count(*) AS pages_confirmed, sum(hits)::BIGINT AS hits, sum(rejected)::BIGINT AS rejected_hits,
  CASE WHEN sum(hits) >= 2000 THEN 'limit' ELSE 'running' END AS query_status,
  CASE WHEN sum(hits) >= 2000 THEN 'partial' END AS coverage, CASE WHEN sum(hits) >= 2000 THEN 'limit' END AS reason
FROM pages GROUP BY 1
UNION ALL
SELECT collection_id || '+end', count(*) + 1, sum(hits)::BIGINT, sum(rejected)::BIGINT, 'exhausted',
  CASE WHEN sum(rejected) > 0 THEN 'partial' ELSE 'complete' END, CASE WHEN sum(rejected) > 0 THEN 'rejections' END
FROM pages GROUP BY 1""")
def page_coverage(spark, sf_dir):
    """Coverage per collection, with and without the empty page that proves the end."""
    hits = F.count(F.lit(1))
    pages = _page_events(spark, sf_dir).groupBy(F.col("event_type").alias("collection_id"), "page_revision").agg(
        hits.alias("hits"), F.count_if(F.col("value") < 5).alias("rejected_hits")
    )
    full = pages.withColumns(
        {"valid_hits": F.col("hits") - F.col("rejected_hits"), "new": F.lit(0), "updated": F.lit(0), "unchanged": F.lit(0),
         "quarantine_records": F.col("rejected_hits")}
    )
    end = full.groupBy("collection_id").agg((F.max("page_revision") + 1).alias("page_revision")).withColumns(
        {name: F.lit(0) for name in L.PAGE_COUNTERS}
    )
    ended = full.unionByName(end).withColumn("collection_id", F.concat("collection_id", F.lit("+end")))
    both = L.collection_coverage(full, budget=2000).unionByName(L.collection_coverage(ended, budget=None))
    return both.select("collection_id", "pages_confirmed", "hits", "rejected_hits", "query_status", "coverage", "reason")


@query("budget_cap", _PAGE_EVENTS + """, ranked AS (
  SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM log)
SELECT event_id, event_type FROM ranked WHERE n <= 150""")
def budget_cap(spark, sf_dir):
    """The first 150 hits of every collection, cut inside a page."""
    events = _page_events(spark, sf_dir).drop("hit_ordinal").withColumn("collection_id", F.col("event_type"))
    # Positions are counted inside each page of at most 100 hits.
    from pyspark.sql import Window

    inside = Window.partitionBy("collection_id", "page_revision").orderBy("event_id")
    hits = events.withColumn("hit_ordinal", F.row_number().over(inside))
    pages = hits.groupBy("collection_id", "page_revision").agg(F.count(F.lit(1)).alias("hits"))
    kept = L.keep_within_budget(hits, L.cap_to_budget(pages, 150))
    return kept.select("event_id", "event_type")


_CURSOR = """WITH log AS (SELECT user_id, event_id, epoch_us(date_trunc('hour', ts))::BIGINT AS s1, event_type AS s2 FROM events),
c AS (SELECT *, lag(s1) OVER w AS p1, lag(s2) OVER w AS p2, lag(event_id) OVER w AS before FROM log
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query("cursor_breaks", _CURSOR + """ SELECT event_id FROM c WHERE before IS NOT NULL AND NOT (s1 > p1 OR (s1 = p1 AND s2 > p2))""")
def cursor_breaks(spark, sf_dir):
    """Hits whose compound cursor does not advance strictly."""
    hits = standins.read(spark, sf_dir, "events").select(
        "user_id", "event_id", F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("s1"),
        F.col("event_type").alias("s2"),
    )
    return L.cursor_breaks(hits, ["user_id"], ["event_id"], O.number_bucket(F.col("event_id"), 5000), ["s1", "s2"]).select("event_id")


@query("page_sort_check", """WITH log AS (SELECT event_id // 100 AS page, event_id, epoch_us(date_trunc('hour', ts))::BIGINT AS s1, event_type AS s2 FROM events),
c AS (SELECT *, lag(s1) OVER w AS p1, lag(s2) OVER w AS p2 FROM log WINDOW w AS (PARTITION BY page ORDER BY event_id))
SELECT page, count(*) AS hits, bool_and(p1 IS NULL OR s1 > p1 OR (s1 = p1 AND s2 >= p2)) AS ordered,
  count(*) - count(DISTINCT s1) AS primary_ties FROM c GROUP BY page""")
def page_sort_check(spark, sf_dir):
    """Whether each page is sorted, ties allowed, and how often its primary sort value repeats."""
    hits = standins.read(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 100).alias("page"), "event_id",
        F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("s1"), F.col("event_type").alias("s2"),
    )
    return L.sorted_pages(hits, ["page"], "event_id", ["s1", "s2"])


@query("page_boundaries", """WITH log AS (SELECT event_id // 100 AS page, event_id, epoch_us(ts)::BIGINT // 60000000 AS s1, user_id FROM events),
c AS (SELECT *, lag(s1) OVER (PARTITION BY page ORDER BY event_id) AS p1 FROM log),
ends AS (SELECT page, bool_and(p1 IS NULL OR s1 >= p1) AS ordered, arg_min(s1, event_id) AS f, arg_max(s1, event_id) AS l,
  count(user_id) - count(DISTINCT user_id) AS repeats FROM c GROUP BY page),
shared AS (SELECT a.page, count(*) AS overlap FROM (SELECT DISTINCT page, user_id FROM log) a JOIN (SELECT DISTINCT page, user_id FROM log) b
  ON b.page = a.page + 1 AND a.user_id = b.user_id GROUP BY 1)
SELECT a.page AS page, coalesce(overlap, 0) AS overlap, a.repeats + b.repeats + coalesce(overlap, 0) AS duplicates, a.l < b.f AS in_order,
  CASE WHEN a.l = b.l OR a.repeats + b.repeats + coalesce(overlap, 0) > 0 OR NOT a.ordered OR NOT b.ordered OR a.l > b.f THEN 'INCOMPATIBLE'
    WHEN a.l = b.f THEN 'INCONCLUSIVE' ELSE 'VALIDATED' END AS state
FROM ends a JOIN ends b ON b.page = a.page + 1 LEFT JOIN shared s ON s.page = a.page""")
def page_boundaries(spark, sf_dir):
    """Adjacent pages: order across the boundary and documents on both."""
    hits = standins.read(spark, sf_dir, "events").select(
        F.lit("events").alias("collection_id"), F.floor(F.col("event_id") / 100).alias("page"), "event_id",
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("s1"), "user_id",
    )
    return L.page_boundaries(hits, ["collection_id"], "page", "event_id", ["s1"], "user_id").drop("collection_id")


@query("rolling_quota", """WITH log AS (SELECT event_id, event_type, epoch_us(ts)::BIGINT AS us FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window,
  us - lag(us) OVER (PARTITION BY event_type ORDER BY us, event_id) AS gap FROM log)
SELECT event_id, in_window, in_window > 4 AS over_quota, coalesce(gap < 60000000, false) AS too_close FROM c""")
def rolling_quota(spark, sf_dir):
    """More than four starts in any rolling hour, and starts less than a minute apart."""
    starts = standins.read(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    audited = L.quota_audit(starts, ["event_type"], "ts", ["ts", "event_id"], seconds=3600, limit=4, spacing_millis=60_000)
    return audited.select("event_id", "in_window", "over_quota", "too_close")


@query("quarantine_resolution", f"""{_WITH} SELECT collection_id, page_key, l_linenumber AS hit_ordinal, validation_code,
  CASE WHEN validation_code = 'SOURCE_ID_MISMATCH' THEN 'resolved' ELSE 'pending' END AS resolution
FROM hits WHERE validation_code IS NOT NULL""")
def quarantine_resolution(spark, sf_dir):
    """Rejected hits tried again after their source repaired its identifiers."""
    prepared = _prepared(spark, sf_dir)
    rejections = ingest.cover_rejections(prepared)
    repaired = rejections.withColumn("hit", F.regexp_replace("hit", '"id":"other-', '"id":"')).withColumnRenamed("first_observed_at", "responded_at")
    again = ingest.prepare_hits(repaired.select(
        "collection_id", "page_revision", "page_key", "hit_ordinal", "responded_at", "tribunal", "mode", "hit"
    ))
    issues = ingest.cover_rejections(again)
    return L.quarantine_resolutions(rejections, issues).select(*ingest.POSITION, "validation_code", "resolution")


@query("late_projection", f"""{_WITH}, firsts AS (
  SELECT l_orderkey, l_suppkey, l_shipdate, l_partkey, l_returnflag FROM lineitem)
SELECT l_orderkey, arg_max(l_partkey::VARCHAR, struct_pack(a := l_shipdate, b := CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, c := l_partkey::VARCHAR)) AS version_id
FROM firsts GROUP BY l_orderkey""".replace(f"{_WITH}, ", "WITH "))
def late_projection(spark, sf_dir):
    """Late versions replace a projection only when they were first observed later."""
    line = standins.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("representation_id"), F.col("l_partkey").cast("string").alias("version_id"),
        F.col("l_shipdate").alias("first_observed_at"), "l_returnflag",
    )
    out = L.late_projection(line.where("l_returnflag <> 'R'"), line.where("l_returnflag = 'R'"))
    return out.select(F.col("representation_id").alias("l_orderkey"), "version_id")
