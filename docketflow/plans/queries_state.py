"""Watch lists, news, decisions, definitions, schedules and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.functions import dates as D
from docketflow.functions import jsonvalue as J
from docketflow.operators import definitions as N
from docketflow.operators import movements as M
from docketflow.operators import ordered as O
from docketflow.operators import watch as W
from docketflow.plans import ingest, standins
from docketflow.plans.registry import query
from docketflow.plans.sqlparts import HITS, TRIBUNAL_LIST
from docketflow.session import stored as written
from docketflow.sources import reference

_TOGGLES = """WITH log AS (SELECT user_id, event_id, ts, event_type = 'signup' AS wanted FROM events WHERE event_type IN ('signup', 'error')),
c AS (SELECT *, coalesce(lag(wanted) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS before FROM log),
eff AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM c WHERE wanted <> before),
cycles AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle_number, ts AS started_at, next_ts AS ended_at
  FROM eff WHERE wanted)"""


def _toggle_log(spark, sf_dir):
    return standins.read(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error")).select(
        F.col("user_id").alias("process_id"), "event_id", F.col("ts").cast("timestamp").alias("at"),
        (F.col("event_type") == "signup").alias("wanted"),
    )


@query("watch_intervals", _TOGGLES + """ SELECT user_id, cycle_number, epoch_us(started_at) AS started, epoch_us(ended_at) AS ended FROM cycles""")
def watch_intervals(spark, sf_dir):
    """Numbered watch intervals from inclusion and removal requests."""
    return W.watch_cycles(_toggle_log(spark, sf_dir)).select(
        F.col("process_id").alias("user_id"), "cycle_number", F.unix_micros("started_at").alias("started"),
        F.unix_micros("ended_at").alias("ended"),
    )


@query("watch_state", _TOGGLES + """ SELECT user_id, ended_at IS NULL AS active, epoch_us(started_at) AS included,
  CASE WHEN ended_at IS NULL THEN strftime(CASE WHEN started_at < date_trunc('day', started_at) + INTERVAL 9 HOUR
    THEN date_trunc('day', started_at) + INTERVAL 9 HOUR ELSE date_trunc('day', started_at) + INTERVAL 33 HOUR END, '%Y-%m-%d %H:%M') END AS next_run
FROM cycles QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cycle_number DESC) = 1""")
def watch_state(spark, sf_dir):
    """Who is watched now, since when, and the next run at 06:00 local time."""
    return W.watch_state(_toggle_log(spark, sf_dir)).select(
        F.col("process_id").alias("user_id"), "active", F.unix_micros("included_at").alias("included"),
        F.date_format("next_run_at", "yyyy-MM-dd HH:mm").alias("next_run"),
    )


_NEWS = f"""WITH {HITS}, cycles AS (
  SELECT 'p' || o_orderkey AS process_id, o_orderkey, o_orderdate AS started_at,
    CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderdate + to_days(900) END AS ended_at FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')),
ordinals AS (SELECT *, {{'at': first_at, 'v': version_id}} AS now, unnest(generate_series(1, copies)) AS ordinal FROM contents),
occ AS (SELECT representation_id, content_sha256, ordinal, min(now) AS seen, any_value(auxiliary_key) AS auxiliary_key FROM ordinals GROUP BY 1, 2, 3),
grp AS (SELECT representation_id, auxiliary_key, min(seen) AS group_seen FROM occ GROUP BY 1, 2),
ev AS (SELECT s.representation_id, s.version_id, s.l_shipdate AS observed_at, collection_id || '-' || s.l_partkey || '-' || s.l_linenumber AS obs,
    v.first_at AS processed_at, s.t NOT IN (1, 2, 3, 5) AS is_complete, c.* FROM sound s JOIN versions v USING (representation_id, version_id)
  JOIN cycles c ON c.o_orderkey = s.l_orderkey),
at_start AS (SELECT * FROM ev WHERE observed_at <= started_at
  QUALIFY row_number() OVER (PARTITION BY representation_id ORDER BY observed_at DESC, obs DESC) = 1),
inside AS (SELECT * FROM ev WHERE observed_at > started_at AND (ended_at IS NULL OR observed_at < ended_at)),
est AS (SELECT representation_id, process_id, started_at AS effective_at, started_at AS established_at FROM at_start WHERE is_complete
  UNION ALL (SELECT representation_id, process_id, observed_at, processed_at FROM inside WHERE is_complete
    QUALIFY row_number() OVER (PARTITION BY representation_id ORDER BY observed_at, obs) = 1)),
base AS (SELECT * FROM est QUALIFY row_number() OVER (PARTITION BY representation_id ORDER BY effective_at) = 1)"""


def _watch_inputs(spark, sf_dir):
    valid = ingest.valid_hits(ingest.prepare_hits(standins.line_hits(spark, sf_dir)))
    valid = written(valid.select(*ingest.VERSION_KEYS, "payload", *ingest.OBSERVATION_ORDER), codec="zstd")
    stored = written(ingest.versions(valid).drop("payload_sha256"), codec="zstd")
    elements = M.explode_movements(stored)
    snapshots = M.snapshots(stored, M.movement_issues(stored, elements))
    observations = valid.select(
        F.concat(F.lit("p"), F.substring("collection_id", 2, 20)).alias("process_id"), "representation_id", "version_id", "observed_at",
        F.concat_ws("-", "collection_id", "page_revision", "hit_ordinal").alias("observation_id"),
    )
    orders = standins.read(spark, sf_dir, "orders").where(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    )
    started = F.col("o_orderdate").cast("timestamp")
    cycles = orders.select(
        F.concat(F.lit("p"), F.col("o_orderkey")).alias("process_id"), F.lit(1).alias("cycle_number"), started.alias("started_at"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.date_add("o_orderdate", 900).cast("timestamp")).alias("ended_at"),
    )
    return stored, elements, snapshots, observations, cycles


@query("watch_baselines", _NEWS + """ SELECT process_id, representation_id, strftime(effective_at, '%Y-%m-%d') AS effective,
  strftime(established_at, '%Y-%m-%d') AS established FROM base""")
def watch_baselines(spark, sf_dir):
    """The baseline of every watched representation."""
    _, _, snapshots, observations, cycles = _watch_inputs(spark, sf_dir)
    base = W.baselines(observations, snapshots, cycles)
    return base.select(
        "process_id", "representation_id", F.date_format("effective_at", "yyyy-MM-dd").alias("effective"),
        F.date_format("established_at", "yyyy-MM-dd").alias("established"),
    )


@query("news_representations", _NEWS + """, born AS (SELECT process_id, representation_id, min(observed_at) AS b, any_value(started_at) AS s,
    any_value(ended_at) AS e FROM ev GROUP BY 1, 2)
SELECT process_id, representation_id, 'NEW_REPRESENTATION' AS category FROM born JOIN (SELECT process_id, min(effective_at) AS f FROM base GROUP BY 1) USING (process_id)
WHERE b > s AND (e IS NULL OR b < e) AND f < b""")
def news_representations(spark, sf_dir):
    """Representations that appear while another one of the process has a baseline."""
    _, _, snapshots, observations, cycles = _watch_inputs(spark, sf_dir)
    base = W.baselines(observations, snapshots, cycles)
    return W.new_representations(observations, snapshots, cycles, base).select("process_id", "representation_id", "category")


@query("news_movements", _NEWS + """, later AS (SELECT i.representation_id, i.process_id, i.version_id, established_at FROM inside i
    JOIN base b ON b.representation_id = i.representation_id WHERE is_complete AND i.observed_at > effective_at)
SELECT DISTINCT l.process_id, l.representation_id, o.content_sha256, o.ordinal::BIGINT AS ordinal,
  CASE WHEN f.seen > g.group_seen AND o.ordinal = 1 THEN 'ALTERATION_OBSERVED' ELSE 'NEW_OBSERVATION' END AS category
FROM later l JOIN ordinals o ON o.representation_id = l.representation_id AND o.version_id = l.version_id
JOIN occ x ON x.representation_id = o.representation_id AND x.content_sha256 = o.content_sha256 AND x.ordinal = o.ordinal
JOIN occ f ON f.representation_id = o.representation_id AND f.content_sha256 = o.content_sha256 AND f.ordinal = 1
JOIN grp g ON g.representation_id = o.representation_id AND g.auxiliary_key = o.auxiliary_key
WHERE x.seen.at > l.established_at""".replace("CASE WHEN f.seen > g.group_seen AND o.ordinal = 1", "CASE WHEN f.seen > g.group_seen AND x.seen = f.seen"))
def news_movements(spark, sf_dir):
    """Occurrences first observed after their baseline, alterations told apart."""
    from docketflow.operators import reconcile as R

    stored, elements, snapshots, observations, cycles = _watch_inputs(spark, sf_dir)
    contents = written(M.snapshot_contents(M.normalize(elements)), codec="zstd")
    present = M.present_associations(contents, M.occurrences(contents))
    base = W.baselines(observations, snapshots, cycles)
    news = W.movement_news(observations, snapshots, cycles, base, present, M.NORMALIZER_V1)
    ranges = news.select("process_id", "representation_id", "content_sha256", "category", "first_ordinal", "last_ordinal")
    return R.expand_ranges(ranges).select("process_id", "representation_id", "content_sha256", "ordinal", "category")


_DECISIONS = """WITH log AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'relevant' WHEN 'error' THEN 'discarded' ELSE 'pending' END AS decision,
  CASE WHEN event_type = 'purchase' THEN 'confirmed' ELSE 'unconfirmed' END AS rural_link, CASE WHEN value > 20 THEN 'nota' ELSE '' END AS note FROM events),
ok AS (SELECT * FROM log WHERE rural_link <> 'confirmed' OR note <> ''),
c AS (SELECT *, lag(decision, 1, 'pending') OVER w AS d, lag(rural_link, 1, 'unconfirmed') OVER w AS r, lag(note, 1, '') OVER w AS n FROM ok
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
hist AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM c WHERE decision <> d OR rural_link <> r OR note <> n)"""


def _decision_log(spark, sf_dir):
    kind = F.col("event_type")
    return standins.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("process_id"), "event_id",
        F.when(kind == "view", "relevant").when(kind == "error", "discarded").otherwise("pending").alias("decision"),
        F.when(kind == "purchase", "confirmed").otherwise("unconfirmed").alias("rural_link"),
        F.when(F.col("value") > 20, " nota ").otherwise(" ").alias("note"),
    )


@query("decision_history", _DECISIONS + " SELECT user_id, version, event_id, decision, rural_link, note FROM hist")
def decision_history(spark, sf_dir):
    """Versioned decisions; repeats change nothing and a confirmed link needs a note."""
    folded = N.fold_decisions(_decision_log(spark, sf_dir), ["event_id"], O.number_bucket(F.col("event_id"), 5000))
    return folded.select(F.col("process_id").alias("user_id"), "version", "event_id", "decision", "rural_link", "note")


@query("decision_current", _DECISIONS + """ SELECT user_id, max(version) AS version, arg_max(decision, version) AS decision,
  arg_max(rural_link, version) AS rural_link FROM hist GROUP BY 1""")
def decision_current(spark, sf_dir):
    """The decision in force per process."""
    folded = N.fold_decisions(_decision_log(spark, sf_dir), ["event_id"], O.number_bucket(F.col("event_id"), 5000))
    return N.current_decisions(folded).select(F.col("process_id").alias("user_id"), "version", "decision", "rural_link")


@query("decision_requests", """WITH RECURSIVE req AS (SELECT user_id, event_id, (json_extract(props, '$.k')::INT) % 4 AS expected,
  CASE event_type WHEN 'view' THEN 'relevant' WHEN 'error' THEN 'discarded' WHEN 'click' THEN NULL ELSE 'pending' END AS decision,
  CASE WHEN value > 30 THEN 'nota' ELSE '' END AS note FROM events),
chain AS (
  SELECT DISTINCT user_id, 0 AS version, -1::BIGINT AS at_id, 'pending' AS decision, '' AS note FROM req
  UNION ALL
  SELECT * FROM (SELECT c.user_id, c.version + 1, r.event_id, coalesce(r.decision, c.decision), r.note FROM chain c JOIN req r
    ON r.user_id = c.user_id AND r.expected = c.version AND r.event_id > c.at_id
    AND (coalesce(r.decision, c.decision) <> c.decision OR r.note <> c.note)
    QUALIFY row_number() OVER (PARTITION BY c.user_id ORDER BY r.event_id) = 1))
SELECT user_id, version, decision, note FROM chain WHERE version > 0""")
def decision_requests(spark, sf_dir):
    """Decision requests that name the version they expect; stale ones are refused."""
    kind = F.col("event_type")
    requests = standins.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("process_id"), "event_id",
        (F.get_json_object("props", "$.k").cast("int") % 4).alias("expected_version"),
        F.when(kind == "view", "relevant").when(kind == "error", "discarded").when(kind != "click", "pending").alias("decision"),
        F.lit(None).cast("string").alias("rural_link"), F.when(F.col("value") > 30, "nota").otherwise("").alias("note"),
    )
    return N.fold_requests(requests, ["event_id"]).select(F.col("process_id").alias("user_id"), "version", "decision", "note")


@query("definition_versions", """WITH log AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderpriority < '3' THEN o_orderpriority END AS p FROM orders),
c AS (SELECT *, lag(o_orderstatus) OVER w AS s, lag(p) OVER w AS q, row_number() OVER w AS n FROM log WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM c
WHERE n = 1 OR o_orderstatus IS DISTINCT FROM s OR p IS DISTINCT FROM q""")
def definition_versions(spark, sf_dir):
    """New versions of saved definitions on real changes only."""
    log = standins.read(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority")).alias("p")
    )
    out = N.definition_versions(log, "o_custkey", ["o_orderstatus", "p"], ["o_orderkey"], O.number_bucket(F.col("o_orderkey"), 50_000))
    return out.select("o_custkey", "o_orderkey", "version")


@query("definition_drift", """SELECT p_partkey AS saved_id, p_type AS item_id,
  CASE WHEN p_size > 40 THEN 'SAVED_PRESET_VERSION_CHANGED' ELSE 'SAVED_PRESET_FILTERS_CHANGED' END AS reason
FROM part WHERE p_size > 40 OR p_size % 5 <> 0""")
def definition_drift(spark, sf_dir):
    """Saved definitions whose catalog item changed its version or its codes."""
    part = standins.read(spark, sf_dir, "part")
    saved = part.select(
        F.col("p_partkey").alias("saved_id"), F.col("p_type").alias("item_id"),
        F.when(F.col("p_size") > 40, "0").otherwise("1").alias("item_version"), F.array(F.col("p_size") % 5).alias("codes"),
    )
    items = part.select(F.col("p_type").alias("item_id")).distinct().select("item_id", F.lit("1").alias("version"), F.array(F.lit(0)).alias("codes"))
    return N.definition_drift(saved, items)


@query("due_report", """SELECT o_orderkey AS target_id, strftime(o_orderdate - INTERVAL 3 HOUR, '%Y-%m-%d') AS due_date, o_orderdate + INTERVAL 9 HOUR < '2001-07-01 09:00:00' AS missed
FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate + INTERVAL 9 HOUR <= '2001-07-01 09:00:00'""".replace("o_orderdate - INTERVAL 3 HOUR", "o_orderdate"))
def due_report(spark, sf_dir):
    """Enabled targets that are due at an instant."""
    targets = standins.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("target_id"), (F.col("o_orderstatus") != "F").alias("enabled"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 9 HOURS")).alias("next_run_at"),
    )
    due = N.due_report(targets, F.lit("2001-07-01 09:00:00").cast("timestamp"))
    return due.select("target_id", F.col("due_date").cast("string").alias("due_date"), "missed")


@query("coalesced_misses", """SELECT o_custkey AS target_id, strftime(min(CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END), '%Y-%m-%d') AS missed_from,
  strftime(max(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END), '%Y-%m-%d') AS missed_through, count(*) AS dispatches FROM orders GROUP BY 1""")
def coalesced_misses(spark, sf_dir):
    """Missed days per target as one range."""
    day = F.to_date("o_orderdate")
    dispatches = standins.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("target_id"), F.when(F.col("o_orderstatus") != "F", day).alias("missed_from"),
        F.when(F.col("o_orderstatus") != "O", day).alias("missed_through"),
    )
    out = N.coalesced_misses(dispatches)
    return out.withColumns({n: F.col(n).cast("string") for n in ("missed_from", "missed_through")})


@query("active_dedupe", """WITH runs AS (SELECT o_orderkey AS run_id, sha256('{"query":{"cust":' || o_custkey || '},"source":"registry","tribunal":"TJGO","type":"'
  || CASE WHEN o_orderpriority < '3' THEN 'refresh_number' ELSE 'collect_preset' END || '"}') AS operation_key FROM orders WHERE o_orderstatus = 'O')
SELECT operation_key, min(run_id) AS run_id FROM runs GROUP BY 1""")
def active_dedupe(spark, sf_dir):
    """One open run per operation."""
    kind = F.when(F.col("o_orderpriority") < "3", "refresh_number").otherwise("collect_preset")
    wanted = J.json_object(("cust", F.col("o_custkey").cast("string")))
    runs = standins.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("completed").alias("status"),
        N.operation_key(kind, F.lit("registry"), F.lit("TJGO"), wanted).alias("operation_key"),
    )
    return N.active_operations(runs, ["run_id"]).select("operation_key", "run_id")


@query("refresh_states", f"""WITH runs AS (SELECT o_custkey::VARCHAR AS process_number, {TRIBUNAL_LIST}[(o_orderkey % 3 + 1)::INT] AS tribunal, o_orderkey AS run_id, o_orderdate,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'failed' ELSE 'completed' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 3 END AS hits FROM orders),
l AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY process_number, tribunal ORDER BY o_orderdate DESC, run_id DESC) = 1)
SELECT process_number, tribunal, run_id, CASE WHEN status = 'running' THEN 'pending' WHEN status = 'failed' THEN 'failed'
  WHEN hits > 0 THEN 'found' WHEN hits = 0 THEN 'absent_in_query' ELSE 'partial' END AS state, hits::BIGINT AS hit_count FROM l""")
def refresh_states(spark, sf_dir):
    """The last refresh per number and tribunal; without a count nothing is proven absent."""
    priority = F.col("o_orderpriority")
    runs = standins.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("process_number"), standins.tribunal_of((F.col("o_orderkey") % 3).cast("int")).alias("tribunal"),
        F.col("o_orderkey").alias("run_id"), F.when(priority == "1-URGENT", "running").when(priority == "2-HIGH", "failed")
        .otherwise("completed").alias("status"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 3).cast("long").alias("hit_count"),
        F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"),
    )
    return W.refresh_states(runs).select("process_number", "tribunal", "run_id", "state", "hit_count")


@query("refresh_latest", f"""WITH runs AS (SELECT o_custkey::VARCHAR AS process_number, {TRIBUNAL_LIST}[(o_orderkey % 3 + 1)::INT] AS tribunal, o_orderkey AS run_id, o_orderdate FROM orders),
l AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY process_number, tribunal ORDER BY o_orderdate DESC, run_id DESC) = 1)
SELECT process_number, tribunal, run_id FROM l QUALIFY row_number() OVER (PARTITION BY process_number ORDER BY o_orderdate DESC, tribunal DESC) = 1""")
def refresh_latest(spark, sf_dir):
    """The refresh of each number that was checked last."""
    runs = standins.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("process_number"), standins.tribunal_of((F.col("o_orderkey") % 3).cast("int")).alias("tribunal"),
        F.col("o_orderkey").alias("run_id"), F.lit("completed").alias("status"), F.lit(1).cast("long").alias("hit_count"),
        F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"),
    )
    return W.most_recent_refresh(W.refresh_states(runs)).select("process_number", "tribunal", "run_id")


_MEMBER = "CASE o_orderpriority WHEN '1-URGENT' THEN 'RUNNING' WHEN '2-HIGH' THEN 'BLOCKED_NOT_VALIDATED' WHEN '3-MEDIUM' THEN 'COMPLETED' WHEN '4-NOT SPECIFIED' THEN 'FAILED' ELSE 'CANCELLED' END"


@query("group_rollup", f"""WITH m AS (SELECT o_custkey AS group_id, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'NOT_RUN' WHEN o_orderpriority = '1-URGENT' THEN 'PARTIAL' ELSE {_MEMBER} END AS s, o_orderdate FROM orders),
g AS (SELECT group_id, count(*) AS member_count, count(*) FILTER (s IN ('COMPLETED', 'PARTIAL')) AS completed_count, max(o_orderdate) AS u,
  list(DISTINCT s) AS states FROM m GROUP BY 1)
SELECT group_id, member_count, completed_count, floor(completed_count * 100 / member_count)::BIGINT AS percent, strftime(u, '%Y-%m-%d') AS updated_day,
  CASE WHEN completed_count > 0 AND list_has_any(states, ['PARTIAL', 'FAILED', 'BLOCKED_NOT_VALIDATED', 'NOT_RUN', 'CANCELLED']) THEN 'partial'
    WHEN NOT list_has_any(states, ['COMPLETED', 'PARTIAL', 'FAILED', 'CANCELLED']) THEN 'blocked'
    WHEN list_contains(states, 'FAILED') AND completed_count = 0 THEN 'failed'
    WHEN NOT list_has_any(states, ['COMPLETED', 'PARTIAL', 'FAILED']) THEN 'cancelled'
    WHEN NOT list_has_any(states, ['PARTIAL', 'FAILED', 'CANCELLED', 'BLOCKED_NOT_VALIDATED', 'NOT_RUN']) THEN 'completed' ELSE 'failed' END AS group_state
FROM g""")
def group_rollup(spark, sf_dir):
    """State and progress of execution groups."""
    priority = F.col("o_orderpriority")
    state = (
        F.when((priority == "1-URGENT") & (F.col("o_orderstatus") == "F"), "NOT_RUN").when(priority == "1-URGENT", "PARTIAL")
        .when(priority == "2-HIGH", "BLOCKED_NOT_VALIDATED").when(priority == "3-MEDIUM", "COMPLETED")
        .when(priority == "4-NOT SPECIFIED", "FAILED").otherwise("CANCELLED")
    )
    members = standins.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("group_id"), state.alias("state"), F.col("o_orderdate").alias("updated_at")
    )
    out = N.group_rollup(members)
    return out.withColumn("updated_day", F.date_format("updated_at", "yyyy-MM-dd")).drop("updated_at")


@query("group_fingerprint", """WITH m AS (SELECT o_custkey AS group_id, o_orderpriority AS tribunal, '{"mode":"demo","query":{"k":' || (o_orderkey % 3) || '},"sort":[],"source":"synthetic","tribunal":"'
    || o_orderpriority || '","type":"' || o_orderstatus || '"}' AS t FROM orders)
SELECT group_id, sha256('{"kind":"' || CASE WHEN group_id % 2 = 0 THEN 'search' ELSE 'preset' END || '","operations":[' || string_agg(t, ',' ORDER BY tribunal, t) || '],"target_id":"t' || (group_id // 10) || '"}') AS fingerprint
FROM m GROUP BY 1""")
def group_fingerprint(spark, sf_dir):
    """Target, kind and all operations of each group in order, hashed; equal operations count as often as they occur."""
    orders = standins.read(spark, sf_dir, "orders")
    members = orders.select(
        F.col("o_custkey").alias("group_id"), F.concat(F.lit("t"), F.floor(F.col("o_custkey") / 10)).alias("target_id"),
        F.when(F.col("o_custkey") % 2 == 0, "search").otherwise("preset").alias("kind"), F.lit("demo").alias("mode"), F.col("o_orderstatus").alias("type"),
        F.lit("synthetic").alias("source"), F.col("o_orderpriority").alias("tribunal"),
        F.concat(F.lit('{"k":'), F.col("o_orderkey") % 3, F.lit("}")).alias("query"), F.lit("[]").alias("sort"),
    )
    return N.group_fingerprints(members)


_CODES = """codes AS (SELECT p_partkey AS code, p_name AS name, p_brand, p_size, CASE WHEN p_size > 25 THEN 'class' ELSE 'subject' END AS dimension,
  CASE WHEN p_type = 'PROMO' THEN 'I' ELSE 'A' END AS situation, p_retailprice > 950 AS first_grade, p_size % 2 = 0 AS second_grade, p_brand <> 'Brand#1' AS selectable FROM part)"""


def _codes(spark, sf_dir):
    return standins.read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, "class").otherwise("subject").alias("dimension"),
        F.when(F.col("p_type") == "PROMO", "I").otherwise("A").alias("situation"), (F.col("p_retailprice") > 950).alias("tjgo_first_grade"),
        (F.col("p_size") % 2 == 0).alias("tjgo_second_grade"), (F.col("p_brand") != "Brand#1").alias("selectable_for_custom"), "p_type",
    )


@query("code_picker", f"WITH {_CODES} SELECT code, name FROM codes WHERE dimension = 'class' AND situation = 'A' AND selectable AND (first_grade OR second_grade) AND (contains(code::VARCHAR, 'wid') OR contains(lower(name), 'wid'))")
def code_picker(spark, sf_dir):
    """Codes offered for custom definitions, found by a part of their name."""
    return N.code_picker(_codes(spark, sf_dir), "class", " WID ").select("code", "name")


@query("inclusion_explanations", f"WITH {_CODES} SELECT p_brand AS item_id, dimension, code, name, 'OR within this filter; OR with other non-empty dimensions' AS condition FROM codes")
def inclusion_explanations(spark, sf_dir):
    """Each code of each item with its name and how it combines."""
    part = standins.read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("item_id"), F.when(F.col("p_size") > 25, "class").otherwise("subject").alias("dimension"), F.col("p_partkey").alias("code")
    )
    items = part.select("item_id", F.lit("OR").alias("combine")).distinct()
    return N.inclusion_explanations(part, _codes(spark, sf_dir), items).select("item_id", "dimension", "code", "name", "condition")


@query("evidence_gate", """WITH items AS (SELECT p_partkey AS item_id, p_size > 10 AS implemented, p_type, p_size FROM part),
f AS (SELECT *, CASE WHEN p_type <> 'PROMO' THEN 'query_status: ' || CASE WHEN p_type = 'LARGE' THEN 'pending' ELSE 'inconclusive' END || ' — sem amostra' END AS q,
  CASE WHEN p_size > 45 THEN 'tpu_status: missing — ' END AS t FROM items)
SELECT item_id, q IS NULL AND t IS NULL AND implemented AS enabled, concat_ws('; ', q, t) AS reasons FROM f""")
def evidence_gate(spark, sf_dir):
    """Items whose every required evidence is validated."""
    part = standins.read(spark, sf_dir, "part")
    items = part.select(
        F.col("p_partkey").alias("item_id"), (F.col("p_size") > 10).alias("runtime_implemented"),
        F.array(F.lit("query_status"), F.lit("tpu_status")).alias("required"),
    )
    query_rows = part.select(
        F.col("p_partkey").alias("item_id"), F.lit("query_status").alias("evidence_name"),
        F.when(F.col("p_type") == "PROMO", "validated").when(F.col("p_type") == "LARGE", "pending").otherwise("inconclusive").alias("state"),
        F.lit("sem amostra").alias("reason"),
    )
    tpu_rows = part.where("p_size <= 45").select(
        F.col("p_partkey").alias("item_id"), F.lit("tpu_status").alias("evidence_name"), F.lit("validated").alias("state"), F.lit("ok").alias("reason")
    )
    return N.evidence_gate(items, query_rows.unionByName(tpu_rows))


@query("rule_selection", """SELECT DISTINCT CASE p_type WHEN 'PROMO' THEN 'sinal.penhora' WHEN 'LARGE' THEN 'sinal.leilao' ELSE 'outra.' || p_brand END AS rule_id,
  CASE p_type WHEN 'PROMO' THEN 'inactive' WHEN 'LARGE' THEN 'selected' ELSE 'unknown' END AS selection FROM part""")
def rule_selection(spark, sf_dir):
    """Requested rules: selected, inactive in the environment, or unknown."""
    kind = F.col("p_type")
    asked = standins.read(spark, sf_dir, "part").select(
        F.when(kind == "PROMO", "sinal.penhora").when(kind == "LARGE", "sinal.leilao").otherwise(F.concat(F.lit("outra."), "p_brand")).alias("rule_id")
    ).distinct()
    return reference.rule_selection(asked, reference.rules_frame(spark), "real").select("rule_id", "selection")


@query("last_activity", """SELECT l_orderkey, strftime(greatest(max(l_shipdate), max(CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 10 DAY END)), '%Y-%m-%d') AS last_day
FROM lineitem GROUP BY 1""")
def last_activity(spark, sf_dir):
    """The latest of several kinds of moments per process."""
    line = standins.read(spark, sf_dir, "lineitem")
    returned = F.when(F.col("l_returnflag") == "R", F.date_add("l_shipdate", 10))
    out = line.groupBy("l_orderkey").agg(N.last_activity(F.max(F.to_date("l_shipdate")), F.max(returned)).alias("d"))
    return out.select("l_orderkey", F.col("d").cast("string").alias("last_day"))


_FROZEN = """WITH asked AS (SELECT n_name, r_name, o_orderdate::DATE AS d, c_mktsegment, o_orderpriority, o_orderkey % 4 AS part FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
text AS (SELECT n_name, k, '{"query":{"class_codes":' || to_json(list(DISTINCT c_mktsegment ORDER BY c_mktsegment)) || ',"court_unit_code":null,"dimension_combination":"and","filed_from":"' || min(d) || '","filed_to":"' || max(d)
  || '","movement_codes":[],"preset_id":"' || max(r_name) || '","preset_version":1,"process_number":null,"subject_codes":' || to_json(list(DISTINCT o_orderpriority ORDER BY o_orderpriority)) || ',"tribunal":"' || n_name
  || '"},"sort":[{"field_name":"@timestamp","order":"asc"},{"field_name":"id","order":"asc"}],"source":"synthetic","tribunal":"' || n_name || '","type":"collection"}' AS criteria
  FROM asked, (VALUES (0), (1)) v(k) WHERE k = 1 OR part > 0 GROUP BY n_name, k)
SELECT a.n_name, a.criteria, sha256(a.criteria) AS operation_key, sha256(b.criteria) AS previous_key, sha256(a.criteria) IS DISTINCT FROM sha256(b.criteria) AS changed
FROM text a LEFT JOIN text b ON a.n_name = b.n_name AND b.k = 0 WHERE a.k = 1"""


@query("frozen_criteria", _FROZEN)
def frozen_criteria(spark, sf_dir):
    """Criteria of each nation from all orders beside those from three quarters of them: window, segments and priorities."""
    rows = standins.read(spark, sf_dir, "orders").join(standins.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(standins.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        standins.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sort = F.array(*[F.struct(F.lit(name).alias("field_name"), F.lit("asc").alias("order")) for name in ("@timestamp", "id")])

    def frozen(orders):
        requests = orders.groupBy("n_name").agg(
            F.array_sort(F.collect_set("c_mktsegment")).alias("class_codes"), F.array_sort(F.collect_set("o_orderpriority")).alias("subject_codes"),
            F.min(F.col("o_orderdate").cast("date")).alias("filed_from"), F.max(F.col("o_orderdate").cast("date")).alias("filed_to"), F.max("r_name").alias("preset_id"),
        ).select(
            "*", F.col("n_name").alias("tribunal"), F.lit(1).alias("preset_version"), F.lit("and").alias("dimension_combination"), F.lit("synthetic").alias("source"),
            F.lit("collection").alias("job_type"), sort.alias("sort"), F.lit(None).cast("array<string>").alias("movement_codes"),
            F.lit(None).cast("string").alias("court_unit_code"), F.lit(None).cast("string").alias("process_number"),
        )
        return N.frozen_criteria(requests)

    both = N.criteria_drift(frozen(rows.where("o_orderkey % 4 > 0")), frozen(rows), ["n_name"])
    return both.select("n_name", "criteria", "operation_key", "previous_key", "changed")
