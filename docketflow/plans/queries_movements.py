"""Movements: normalisation, multiset comparison, occurrences, rules and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.operators import movements as M
from docketflow.operators import ordered as O
from docketflow.operators import reconcile as R
from docketflow.operators import signals as S
from docketflow.plans import ingest, standins
from docketflow.plans.registry import query
from docketflow.plans.sqlparts import HITS
from docketflow.session import stored as written
from docketflow.sources import reference

_WITH = f"WITH {HITS}"

TEST_RULES = (
    reference.SignalRule("regra.tres", "1", "tres", "Código três", (3,), ("demo",)),
    reference.SignalRule("regra.pares", "2", "pares", "Códigos pares", (2, 4), ("demo", "real")),
)


def _valid(spark, sf_dir):
    return ingest.valid_hits(ingest.prepare_hits(standins.line_hits(spark, sf_dir)))


def _stored(spark, sf_dir):
    """Versions as a written table, since snapshots and movements both read them."""
    valid = _valid(spark, sf_dir).select(*ingest.VERSION_KEYS, "payload", *ingest.OBSERVATION_ORDER)
    return written(ingest.versions(valid).drop("payload_sha256"), codec="zstd")


def _contents(spark, sf_dir):
    return M.snapshot_contents(M.normalize(M.explode_movements(_stored(spark, sf_dir))))


@query("movement_issues", f"""{_WITH} SELECT version_id,
  CASE WHEN t = 5 THEN 'movimentos[1]' ELSE 'movimentos' END AS error_path,
  CASE t WHEN 1 THEN 'MOVEMENTS_FIELD_MISSING' WHEN 2 THEN 'MOVEMENTS_NULL' WHEN 3 THEN 'MOVEMENTS_NOT_ARRAY'
    WHEN 5 THEN 'MOVEMENT_NOT_OBJECT' END AS validation_code FROM versions WHERE t IN (1, 2, 3, 5)""")
def movement_issues(spark, sf_dir):
    """Array and element problems of every version."""
    stored = _stored(spark, sf_dir)
    return M.movement_issues(stored, M.explode_movements(stored)).select("version_id", "error_path", "validation_code")


@query("movement_snapshots", f"""{_WITH} SELECT version_id, (t IN (1, 2, 3, 5))::INT::BIGINT AS rejection_count,
  t NOT IN (1, 2, 3, 5) AS is_complete FROM versions""")
def movement_snapshots(spark, sf_dir):
    """Completeness per version; an explicit empty array is complete."""
    stored = _stored(spark, sf_dir)
    issues = M.movement_issues(stored, M.explode_movements(stored))
    return M.snapshots(stored, issues).select("version_id", "rejection_count", "is_complete")


@query("movement_content", f"""{_WITH} SELECT version_id, position, content_sha256, auxiliary_key,
  CASE WHEN code > 0 THEN code::VARCHAR END AS code, 'timezone_aware' AS date_status FROM movements""")
def movement_content(spark, sf_dir):
    """Content hash and auxiliary key of every movement."""
    normalized = M.normalize(M.explode_movements(_stored(spark, sf_dir)))
    return normalized.select("version_id", "position", "content_sha256", "auxiliary_key", "code", "date_status")


_SEEN = """, ordinals AS (
  SELECT *, {'at': first_at, 'v': version_id} AS now, unnest(generate_series(1, copies)) AS ordinal FROM contents),
occ AS (SELECT representation_id, content_sha256, ordinal, min(now) AS seen, any_value(auxiliary_key) AS auxiliary_key
  FROM ordinals GROUP BY 1, 2, 3),
grp AS (SELECT representation_id, auxiliary_key, min(seen) AS group_seen FROM occ GROUP BY 1, 2)"""


@query("movement_occurrences", _WITH + _SEEN + """
SELECT representation_id, content_sha256, ordinal::BIGINT AS ordinal, seen.v AS first_version FROM occ""")
def movement_occurrences(spark, sf_dir):
    """Every occurrence with the snapshot that first held it."""
    ranges = M.occurrences(_contents(spark, sf_dir)).select(
        "representation_id", "content_sha256", "first_ordinal", "last_ordinal", F.col("seen.version_id").alias("first_version")
    )
    return R.expand_ranges(ranges).select("representation_id", "content_sha256", "ordinal", "first_version")


@query("movement_statuses", _WITH + _SEEN + """
SELECT o.version_id, o.content_sha256, o.ordinal::BIGINT AS ordinal,
  CASE WHEN occ.seen <> o.now THEN 'KNOWN' WHEN occ.ordinal = any_first AND g.group_seen < o.now AND f.seen = o.now THEN 'ALTERATION_OBSERVED'
    ELSE 'FIRST_OBSERVED' END AS status
FROM ordinals o JOIN occ USING (representation_id, content_sha256, ordinal)
JOIN (SELECT representation_id, content_sha256, seen, occ.ordinal AS any_ord FROM occ WHERE ordinal = 1) f
  ON f.representation_id = o.representation_id AND f.content_sha256 = o.content_sha256
JOIN grp g ON g.representation_id = o.representation_id AND g.auxiliary_key = o.auxiliary_key,
(SELECT 1) x(one)""".replace("occ.ordinal = any_first AND ", "").replace(",\n(SELECT 1) x(one)", ""))
def movement_statuses(spark, sf_dir):
    """Known, first observed or altered, for everything each snapshot holds."""
    contents = written(_contents(spark, sf_dir), codec="zstd")
    present = M.present_associations(contents, M.occurrences(contents)).select(
        "version_id", "content_sha256", "first_ordinal", "last_ordinal", "status"
    )
    return R.expand_ranges(present).select("version_id", "content_sha256", "ordinal", "status")


@query("movement_absences", _WITH + _SEEN + """, chosen AS (
  SELECT representation_id, max({'at': first_at, 'v': version_id}) AS now FROM versions WHERE t NOT IN (1, 2, 3, 5) GROUP BY 1)
SELECT occ.representation_id, occ.content_sha256, occ.ordinal::BIGINT AS ordinal FROM occ JOIN chosen c USING (representation_id)
LEFT JOIN contents h ON h.representation_id = occ.representation_id AND h.content_sha256 = occ.content_sha256 AND h.version_id = c.now.v
WHERE occ.seen < c.now AND occ.ordinal > coalesce(h.copies, 0)""")
def movement_absences(spark, sf_dir):
    """What the latest complete snapshot of each representation no longer holds."""
    stored = _stored(spark, sf_dir)
    elements = M.explode_movements(stored)
    contents = written(M.snapshot_contents(M.normalize(elements)), codec="zstd")
    snapshots = M.snapshots(stored, M.movement_issues(stored, elements)).where("is_complete")
    chosen = O.latest(
        snapshots.select("representation_id", "version_id", "processed_at"), ["representation_id"], ["processed_at", "version_id"]
    )
    absent = M.absent_associations(chosen, contents, M.occurrences(contents)).select(
        "representation_id", "content_sha256", "first_ordinal", "last_ordinal"
    )
    return R.expand_ranges(absent).select("representation_id", "content_sha256", "ordinal")


@query("alteration_counts", _WITH + _SEEN + """, altered AS (
  SELECT DISTINCT o.representation_id, o.auxiliary_key, o.version_id, o.now FROM ordinals o
  JOIN occ f ON f.representation_id = o.representation_id AND f.content_sha256 = o.content_sha256 AND f.ordinal = 1
  JOIN grp g ON g.representation_id = o.representation_id AND g.auxiliary_key = o.auxiliary_key
  WHERE f.seen = o.now AND g.group_seen < o.now)
SELECT a.representation_id, a.auxiliary_key, a.version_id,
  (SELECT count(*) FROM occ WHERE occ.representation_id = a.representation_id AND occ.auxiliary_key = a.auxiliary_key AND occ.seen < a.now)::BIGINT AS previous_count,
  (SELECT count(*) FROM ordinals o WHERE o.version_id = a.version_id AND o.auxiliary_key = a.auxiliary_key)::BIGINT AS current_count
FROM altered a""")
def alteration_counts(spark, sf_dir):
    """How many earlier and current occurrences stand behind each observed alteration."""
    contents = written(_contents(spark, sf_dir), codec="zstd")
    occurrences = M.occurrences(contents)
    present = M.present_associations(contents, occurrences)
    counts = M.alteration_counts(contents, occurrences, present)
    return counts.select("representation_id", "auxiliary_key", "version_id", "previous_count", "current_count")


@query("snapshot_digest", f"""{_WITH}, hashes AS (
  SELECT version_id, list(content_sha256 ORDER BY position) AS h FROM movements GROUP BY 1),
parts AS (SELECT version_id, sha256('["' || sha256('["' || array_to_string(h, '","') || '"]') || '"]') AS digest FROM hashes),
joined AS (SELECT v.version_id, coalesce(digest, '') AS movements, v.t IN (1, 2, 3, 5) AS broken,
  CASE WHEN t IN (1, 2, 3, 5) THEN sha256('[{{"error_path":"' || CASE WHEN t = 5 THEN 'movimentos[1]' ELSE 'movimentos' END
    || '","validation_code":"' || CASE t WHEN 1 THEN 'MOVEMENTS_FIELD_MISSING' WHEN 2 THEN 'MOVEMENTS_NULL'
       WHEN 3 THEN 'MOVEMENTS_NOT_ARRAY' ELSE 'MOVEMENT_NOT_OBJECT' END || '"}}]') ELSE '' END AS issues
  FROM versions v LEFT JOIN parts USING (version_id))
SELECT version_id, sha256('{{"normalizer_version":"movement-normalizer-v1","complete":' || CASE WHEN broken THEN 'false' ELSE 'true' END
  || ',"movements":"' || movements || '","issues":"' || issues || '"}}') AS result_sha256 FROM joined""")
def snapshot_digest(spark, sf_dir):
    """A digest per snapshot that depends on the order of its movements."""
    stored = _stored(spark, sf_dir)
    elements = M.explode_movements(stored)
    digests = M.snapshot_digests(stored, M.normalize(elements), M.movement_issues(stored, elements))
    return digests.select("version_id", "result_sha256")


@query("multiset_ordinals", """SELECT l_orderkey, l_linenumber, l_returnflag AS raw,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag) AS ordinal FROM lineitem""")
def multiset_ordinals(spark, sf_dir):
    """Ordinals of equal contents, ordered by their raw text and never by position."""
    line = standins.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("raw"))
    ranges = R.raw_evidence(line, ["l_orderkey", "l_linenumber"], "raw").drop("copies")
    return R.expand_ranges(ranges).select("l_orderkey", "l_linenumber", "raw", "ordinal")


def _sides(spark, sf_dir):
    line = standins.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("owner"), F.col("l_linenumber").cast("string").alias("auxiliary_key"),
        F.sha2(F.concat_ws("|", F.col("l_linenumber").cast("string"), "l_linestatus", "l_returnflag"), 256).alias("full"),
        F.sha2(F.concat_ws("|", F.col("l_linenumber").cast("string"), "l_linestatus"), 256).alias("short"),
        "l_returnflag",
    )
    return line.where("l_returnflag <> 'A'"), line.where("l_returnflag <> 'R'")


_SIDES = """WITH line AS (SELECT l_orderkey AS owner, l_linenumber::VARCHAR AS auxiliary_key, l_returnflag AS f,
  sha256(l_linenumber || '|' || l_linestatus || '|' || l_returnflag) AS full_hash, sha256(l_linenumber || '|' || l_linestatus) AS short_hash FROM lineitem)"""


@query("snapshot_diff", _SIDES + """,
cur AS (SELECT owner, short_hash AS hash, row_number() OVER (PARTITION BY owner, short_hash) AS ordinal FROM line WHERE f <> 'A'),
old AS (SELECT owner, short_hash AS hash, row_number() OVER (PARTITION BY owner, short_hash) AS ordinal FROM line WHERE f <> 'R')
SELECT coalesce(c.owner, o.owner) AS owner, coalesce(c.hash, o.hash) AS hash, coalesce(c.ordinal, o.ordinal) AS ordinal,
  CASE WHEN c.owner IS NULL THEN 'NOT_PRESENT_IN_SNAPSHOT' WHEN o.owner IS NULL THEN 'FIRST_OBSERVED' ELSE 'KNOWN' END AS status
FROM cur c FULL JOIN old o ON c.owner = o.owner AND c.hash = o.hash AND c.ordinal = o.ordinal
WHERE c.owner IS NOT NULL OR o.owner IN (SELECT owner FROM cur)""")
def snapshot_diff(spark, sf_dir):
    """A snapshot against history as multisets: known, first observed, no longer present."""
    current, history = _sides(spark, sf_dir)
    keys = ["owner", "short"]
    diff = R.reconcile(R.content_counts(current, keys), R.content_counts(history, keys), "owner", "short")
    out = R.expand_ranges(diff.select("owner", "short", "status", "first_ordinal", "last_ordinal"))
    return out.select("owner", F.col("short").alias("hash"), "ordinal", "status")


@query("alteration_match", _SIDES + """,
cur AS (SELECT owner, auxiliary_key, full_hash, count(*) AS n FROM line WHERE f <> 'A' GROUP BY 1, 2, 3),
old AS (SELECT owner, auxiliary_key, full_hash, count(*) AS n FROM line WHERE f <> 'R' GROUP BY 1, 2, 3),
fresh AS (SELECT DISTINCT c.owner, c.auxiliary_key FROM cur c WHERE NOT EXISTS (
    SELECT 1 FROM old o WHERE o.owner = c.owner AND o.full_hash = c.full_hash)
  AND EXISTS (SELECT 1 FROM old o WHERE o.owner = c.owner AND o.auxiliary_key = c.auxiliary_key))
SELECT owner, auxiliary_key, p AS previous_count, n AS current_count, p <> 1 OR n <> 1 AS ambiguous,
  CASE WHEN p = 1 AND n = 1 THEN previous END AS previous_hash
FROM fresh JOIN (SELECT owner, auxiliary_key, sum(n)::BIGINT AS n FROM cur GROUP BY 1, 2) USING (owner, auxiliary_key)
JOIN (SELECT owner, auxiliary_key, sum(n)::BIGINT AS p, min(full_hash) AS previous FROM old GROUP BY 1, 2) USING (owner, auxiliary_key)""")
def alteration_match(spark, sf_dir):
    """New contents beside older ones with the same auxiliary key, ambiguity left visible."""
    current, history = _sides(spark, sf_dir)
    keys = ["owner", "full"]
    return R.alteration_groups(
        R.content_counts(current, keys, ["auxiliary_key"]), R.content_counts(history, keys, ["auxiliary_key"]),
        "owner", "full", "auxiliary_key",
    )


@query("alteration_statuses", _SIDES + """,
cur AS (SELECT owner, auxiliary_key, full_hash, row_number() OVER (PARTITION BY owner, full_hash) AS ordinal FROM line WHERE f <> 'A'),
old AS (SELECT owner, auxiliary_key, full_hash, row_number() OVER (PARTITION BY owner, full_hash) AS ordinal FROM line WHERE f <> 'R')
SELECT c.owner, c.full_hash AS hash, c.ordinal, CASE WHEN o.owner IS NOT NULL THEN 'KNOWN'
  WHEN NOT EXISTS (SELECT 1 FROM old x WHERE x.owner = c.owner AND x.full_hash = c.full_hash)
   AND EXISTS (SELECT 1 FROM old x WHERE x.owner = c.owner AND x.auxiliary_key = c.auxiliary_key) THEN 'ALTERATION_OBSERVED'
  ELSE 'FIRST_OBSERVED' END AS status
FROM cur c LEFT JOIN old o ON c.owner = o.owner AND c.full_hash = o.full_hash AND c.ordinal = o.ordinal""")
def alteration_statuses(spark, sf_dir):
    """The status of every current occurrence with alterations told apart; no snapshot here is complete."""
    current, history = _sides(spark, sf_dir)
    keys = ["owner", "full"]
    diff = R.reconcile(
        R.content_counts(current, keys, ["auxiliary_key"]), R.content_counts(history, keys, ["auxiliary_key"]),
        "owner", "full", "auxiliary_key", complete=current.where("false"),
    )
    out = R.expand_ranges(diff.select("owner", "full", "status", "first_ordinal", "last_ordinal"))
    return out.select("owner", F.col("full").alias("hash"), "ordinal", "status")


def _manifest(spark, sf_dir):
    # Versions with their payloads and the observations are written once; snapshots, movements and the projection all read them.
    valid = _valid(spark, sf_dir).select(*ingest.VERSION_KEYS, "process_number", "payload", *ingest.OBSERVATION_ORDER)
    valid = written(valid, codec="zstd")
    stored = written(ingest.versions(valid).drop("payload_sha256"), codec="zstd")
    elements = M.explode_movements(stored)
    snapshots = M.snapshots(stored, M.movement_issues(stored, elements))
    current = ingest.representations(valid.select("representation_id", "version_id", *ingest.OBSERVATION_ORDER), stored)
    manifest = S.input_manifest(current.withColumnRenamed("process_number", "process_id"), snapshots)
    contents = M.snapshot_contents(M.normalize(elements))
    manifest = written(manifest, codec="zstd")
    ranges = contents.select("version_id", "content_sha256", "code", F.lit(1).alias("first_ordinal"), F.col("copies").alias("last_ordinal"))
    movements = written(R.expand_ranges(ranges), codec="zstd").select(
        "version_id", "code", F.concat_ws(":", "content_sha256", F.col("ordinal").cast("string")).alias("occurrence_id")
    )
    return manifest, movements


_MANIFEST = f"""{_WITH}, complete AS (
  SELECT representation_id, arg_max(version_id, {{'at': first_at, 'v': version_id}}) AS input_version_id FROM versions
  WHERE t NOT IN (1, 2, 3, 5) GROUP BY 1),
newest AS (SELECT representation_id, lpad(l_orderkey::VARCHAR, 20, '0') AS process_id, version_id AS latest_version_id FROM sound
  QUALIFY row_number() OVER (PARTITION BY representation_id ORDER BY l_shipdate DESC, collection_id DESC, l_partkey DESC, l_linenumber DESC) = 1),
manifest AS (SELECT process_id, representation_id, latest_version_id, input_version_id, input_version_id IS NOT NULL AS input_complete,
  input_version_id IS DISTINCT FROM latest_version_id AS evidence_stale FROM newest LEFT JOIN complete USING (representation_id)),
rules AS (SELECT * FROM (VALUES ('regra.tres', '1', 'tres', 3), ('regra.pares', '2', 'pares', 2), ('regra.pares', '2', 'pares', 4)) r(rule_id, rule_version, category, value)),
per_input AS (SELECT version_id, bool_or(code <= 0) AS codeless FROM contents GROUP BY 1),
found AS (SELECT version_id, rule_id, sum(copies)::BIGINT AS n FROM contents JOIN rules ON code = value GROUP BY 1, 2),
evals AS (SELECT m.*, r.rule_id, r.category, CASE WHEN NOT input_complete OR coalesce(codeless, false) THEN 'not_evaluated'
    WHEN n > 0 THEN 'matched' ELSE 'no_match' END AS outcome, CASE WHEN outcome = 'matched' THEN n ELSE 0 END AS match_count
  FROM manifest m, (SELECT DISTINCT rule_id, category FROM rules) r LEFT JOIN per_input p ON p.version_id = m.input_version_id
  LEFT JOIN found f ON f.version_id = m.input_version_id AND f.rule_id = r.rule_id),
statuses AS (SELECT process_id, CASE WHEN bool_or(outcome = 'not_evaluated') THEN 'not_evaluated' WHEN bool_or(evidence_stale) THEN 'stale'
    ELSE 'completed' END AS run_status FROM evals GROUP BY 1)"""


@query("signal_manifest", _MANIFEST + " SELECT * FROM manifest")
def signal_manifest(spark, sf_dir):
    """The snapshot each representation is evaluated on, and whether it is behind."""
    return _manifest(spark, sf_dir)[0]


@query("rule_evaluation", _MANIFEST + " SELECT representation_id, rule_id, outcome, match_count::BIGINT AS match_count FROM evals")
def rule_evaluation(spark, sf_dir):
    """Every input under every rule; one movement without a code leaves its input unevaluated."""
    manifest, movements = _manifest(spark, sf_dir)
    rules = reference.rules_frame(spark, TEST_RULES)
    return S.evaluate(manifest, movements, rules).select("representation_id", "rule_id", "outcome", "match_count")


@query("signal_process_status", _MANIFEST + """ SELECT lpad(o_orderkey::VARCHAR, 20, '0') AS process_id,
  coalesce(run_status, 'completed') AS run_status FROM orders LEFT JOIN statuses ON process_id = lpad(o_orderkey::VARCHAR, 20, '0')""")
def signal_process_status(spark, sf_dir):
    """Publication status of every process of a run."""
    manifest, movements = _manifest(spark, sf_dir)
    evaluations = S.evaluate(manifest, movements, reference.rules_frame(spark, TEST_RULES))
    processes = standins.processes(spark, sf_dir).select(F.col("process_number").alias("process_id"))
    return S.process_status(evaluations, processes)


@query("signal_run_counters", _MANIFEST + """, inputs AS (SELECT representation_id, bool_or(outcome = 'not_evaluated') AS b FROM evals GROUP BY 1)
SELECT (SELECT count(*) FROM inputs) AS total_inputs, (SELECT count(*) FROM inputs WHERE b) AS not_evaluated_inputs,
  count(*) AS total_processes, count(*) FILTER (run_status = 'completed') AS completed_processes,
  count(*) FILTER (run_status = 'stale') AS stale_processes, count(*) FILTER (run_status = 'not_evaluated') AS not_evaluated_processes FROM statuses""")
def signal_run_counters(spark, sf_dir):
    """Totals of a run in one row."""
    manifest, movements = _manifest(spark, sf_dir)
    evaluations = S.evaluate(manifest, movements, reference.rules_frame(spark, TEST_RULES))
    return S.run_counters(evaluations, S.process_status(evaluations, evaluations.select("process_id").distinct()))


@query("desired_signals", _MANIFEST + """, marks AS (SELECT *, content_sha256 || ':' || unnest(generate_series(1, copies)) AS occurrence_id FROM contents)
SELECT m.representation_id, r.rule_id, occurrence_id, r.value::VARCHAR AS code,
  sha256('{"code":' || r.value || ',"evidence_id":"' || occurrence_id || '","predicate":{"field":"codigo","operator":"equals_any","scope":"movement","values":'
    || CASE WHEN r.rule_id = 'regra.tres' THEN '[3]' ELSE '[2,4]' END || '},"rule_id":"' || r.rule_id || '","rule_version":"' || r.rule_version || '"}') AS signal_id
FROM evals e JOIN manifest m USING (representation_id) JOIN marks c ON c.version_id = m.input_version_id
JOIN rules r ON r.rule_id = e.rule_id AND r.value = c.code WHERE e.outcome = 'matched'""")
def desired_signals(spark, sf_dir):
    """The signals a run wants, identified by rule and evidence."""
    manifest, movements = _manifest(spark, sf_dir)
    rules = reference.rules_frame(spark, TEST_RULES)
    evaluations = S.evaluate(manifest, movements, rules)
    wanted = S.desired_signals(manifest, evaluations, movements, rules)
    return wanted.select("representation_id", "rule_id", "occurrence_id", "code", "signal_id")


@query("publication_swap", """WITH line AS (SELECT DISTINCT l_orderkey AS process_id, l_linenumber AS k, l_returnflag AS f,
    CASE WHEN l_linenumber <= 5 THEN 'regra.tres' ELSE 'outra' END AS rule_id FROM lineitem),
old AS (SELECT DISTINCT process_id, k, rule_id, k <> 2 AS is_current, k = 3 AS evidence_stale FROM line WHERE f <> 'R'),
new AS (SELECT DISTINCT process_id, k, rule_id FROM line WHERE f <> 'A' AND rule_id = 'regra.tres'),
statuses AS (SELECT o_orderkey AS process_id, CASE o_orderstatus WHEN 'F' THEN 'not_evaluated' WHEN 'O' THEN 'completed' ELSE 'stale' END AS s FROM orders),
b AS (SELECT coalesce(o.process_id, n.process_id) AS process_id, coalesce(o.k, n.k) AS k, coalesce(o.rule_id, n.rule_id) AS rule_id,
    o.k IS NOT NULL AS was, coalesce(o.is_current, false) AS cur, coalesce(o.evidence_stale, false) AS st, n.k IS NOT NULL AS wanted
  FROM old o FULL JOIN new n ON o.process_id = n.process_id AND o.k = n.k),
j AS (SELECT b.*, s, rule_id = 'regra.tres' AND s <> 'not_evaluated' AS done FROM b JOIN statuses USING (process_id))
SELECT process_id, k AS line, CASE WHEN done AND wanted THEN true ELSE was END AS is_published, CASE WHEN done THEN wanted ELSE cur END AS is_current,
  CASE WHEN done AND wanted THEN s = 'stale' WHEN rule_id = 'regra.tres' AND s = 'not_evaluated' AND cur THEN true ELSE st END AS evidence_stale FROM j""")
def publication_swap(spark, sf_dir):
    """The signal table after a run: swapped, retired, kept and marked stale."""
    line = standins.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("process_id"), F.col("l_linenumber").alias("signal_id"), "l_returnflag",
        F.when(F.col("l_linenumber") <= 5, "regra.tres").otherwise("outra").alias("rule_id"),
    ).withColumns({"representation_id": F.lit("r"), "rule_version": F.lit("1"), "category": F.lit("tres")})
    existing = line.where("l_returnflag <> 'R'").drop("l_returnflag").distinct().withColumns({
        "environment": F.lit("demo"), "is_published": F.lit(True), "is_current": F.col("signal_id") != 2,
        "evidence_stale": F.col("signal_id") == 3,
    })
    desired = line.where("l_returnflag <> 'A' AND rule_id = 'regra.tres'").drop("l_returnflag")
    statuses = standins.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("process_id"),
        F.when(F.col("o_orderstatus") == "F", "not_evaluated").when(F.col("o_orderstatus") == "O", "completed")
        .otherwise("stale").alias("run_status"),
    )
    out = S.publish(existing, desired, statuses, reference.rules_frame(spark, TEST_RULES), "demo")
    return out.select("process_id", F.col("signal_id").alias("line"), "is_published", "is_current", "evidence_stale")
