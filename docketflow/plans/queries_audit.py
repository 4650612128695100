"""Source audits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.functions import jsonvalue as J
from docketflow.operators import audit as U
from docketflow.plans import standins
from docketflow.plans.registry import query


@query("sample_validation", """WITH h AS (SELECT p_brand AS item_id, p_partkey AS hit_id, CASE WHEN l_linenumber IS NULL THEN 0 ELSE 1 END AS has, l_linenumber AS code, p_size
  FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem) ON l_partkey = p_partkey),
m AS (SELECT item_id, hit_id, any_value(p_size) AS doc, bool_or(coalesce(code <= 6, false)) AS c, any_value(p_size) > 1 AS s FROM h GROUP BY 1, 2),
g AS (SELECT item_id, count(*) AS sample_count, count(*) FILTER (c AND s) AS matching_hits, count(*) FILTER (NOT (c AND s)) AS mismatched_hits,
  count(DISTINCT CASE WHEN c AND s THEN doc END) AS distinct_documents FROM m GROUP BY 1)
SELECT *, CASE WHEN mismatched_hits > 0 THEN 'INCOMPATIBLE' ELSE 'VALIDATED' END AS query_state,
  CASE WHEN mismatched_hits > 0 THEN 'INCOMPATIBLE' WHEN distinct_documents >= 3 THEN 'VALIDATED' ELSE 'INCONCLUSIVE' END AS sample_state FROM g
UNION ALL SELECT 'nothing', 0, 0, 0, 0, 'INCONCLUSIVE', 'INCONCLUSIVE'""")
def sample_validation(spark, sf_dir):
    """Whether all hits of an item carry requested codes in every dimension."""
    part = standins.read(spark, sf_dir, "part").select(F.col("p_brand").alias("item_id"), "p_partkey", "p_size")
    lines = standins.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber").distinct()
    movement = part.join(lines, "p_partkey", "left").select(
        "item_id", F.col("p_partkey").alias("hit_id"), F.col("p_size").alias("document_id"),
        F.when(F.col("l_linenumber").isNotNull(), "movement").alias("dimension"), F.col("l_linenumber").alias("code"),
    )
    size = part.select(
        "item_id", F.col("p_partkey").alias("hit_id"), F.col("p_size").alias("document_id"), F.lit("class").alias("dimension"),
        F.col("p_size").alias("code"),
    )
    items = part.select("item_id").distinct().unionByName(spark.range(1).select(F.lit("nothing").alias("item_id")))
    requested = items.select(
        "item_id",
        F.explode(F.concat(
            F.transform(F.sequence(F.lit(1), F.lit(6)), lambda c: F.struct(F.lit("movement").alias("dimension"), c.alias("code"))),
            F.transform(F.sequence(F.lit(2), F.lit(100)), lambda c: F.struct(F.lit("class").alias("dimension"), c.alias("code"))),
        )).alias("r"),
    ).select("item_id", "r.*")
    return U.sample_validation(movement.unionByName(size), requested)


@query("sample_code_counts", """SELECT o_custkey AS item_id, o_orderpriority AS dimension, o_orderstatus AS code, count(DISTINCT o_orderkey) AS hits FROM orders
WHERE o_orderstatus IN ('F', 'P') GROUP BY 1, 2, 3""")
def sample_code_counts(spark, sf_dir):
    """How many hits carry each requested code."""
    hits = standins.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("hit_id"), F.col("o_orderpriority").alias("dimension"),
        F.col("o_orderstatus").alias("code"),
    )
    requested = hits.where(F.col("code").isin("F", "P")).select("item_id", "dimension", "code")
    return U.matched_code_counts(hits, requested)


@query("field_shapes", """WITH n AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'click') AS present,
  count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type NOT IN ('view', 'click')) AS o FROM events)
SELECT 'k' AS path, n AS present_count, n AS sample_count, 'integer' AS types FROM n
UNION ALL SELECT 'kind', n, n, 'string' FROM n UNION ALL SELECT 'value', n, n, 'number' FROM n
UNION ALL SELECT 'maybe', present, n, CASE WHEN v > 0 AND o > 0 THEN 'array,null' WHEN v > 0 THEN 'null' ELSE 'array' END FROM n
UNION ALL SELECT 'nested.flag', n, n, 'boolean' FROM n UNION ALL SELECT 'nested', n, n, 'object' FROM n UNION ALL SELECT 'gone', 0, n, '' FROM n""")
def field_shapes(spark, sf_dir):
    """Presence and JSON types per path of a payload."""
    kind = F.col("event_type")
    maybe = F.when(kind == "view", F.lit(',"maybe":null')).when(kind == "click", F.lit("")).otherwise(F.lit(',"maybe":[1]'))
    text = F.concat(
        F.lit('{"kind":"'), kind, F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit(',"value":'), F.format_string("%.2f", "value"), maybe,
        F.lit(',"nested":{"flag":true}}'),
    )
    events = standins.read(spark, sf_dir, "events").select(text.alias("body"))
    return U.field_shapes(events, F.try_parse_json("body"), ["k", "kind", "value", "maybe", "nested.flag", "nested", "gone"])


@query("quality_assessment", """WITH h AS (SELECT o_custkey AS alias, o_orderstatus AS s, o_orderpriority AS p, o_orderdate::DATE AS d FROM orders),
g AS (SELECT alias, count(*) AS n, count(*) FILTER (s <> 'F' OR p <> '1-URGENT') AS e, count(*) FILTER (s <> 'P' OR p <> '2-HIGH') AS t,
  count(*) FILTER (d >= '1995-02-01' AND d < '2001-07-01') AS r, count(*) FILTER (p <> '5-LOW' OR s <> 'O') AS i, min(d) AS min_date, max(d) AS max_date FROM h GROUP BY 1)
SELECT c_custkey AS alias, coalesce(n, 0) AS sample_count, CASE WHEN n IS NULL THEN 'INCONCLUSIVE' WHEN e = n THEN 'VALIDATED' ELSE 'INCOMPATIBLE' END AS essential_fields,
  CASE WHEN n IS NULL THEN 'INCONCLUSIVE' WHEN t = n THEN 'VALIDATED' ELSE 'INCOMPATIBLE' END AS tribunal_identity,
  CASE WHEN n IS NULL THEN 'INCONCLUSIVE' WHEN r = n THEN 'VALIDATED' ELSE 'INCOMPATIBLE' END AS date_filter,
  CASE WHEN n IS NULL THEN 'INCONCLUSIVE' WHEN i = n THEN 'VALIDATED' ELSE 'INCOMPATIBLE' END AS source_identity, min_date::VARCHAR AS min_date, max_date::VARCHAR AS max_date
FROM customer LEFT JOIN g ON alias = c_custkey""")
def quality_assessment(spark, sf_dir):
    """Essential fields, tribunal, dates and identity of each source's sample."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    key = F.col("o_orderkey").cast("string")
    hits = standins.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("alias"),
        F.when((status == "F") & (priority == "1-URGENT"), "12").otherwise(F.lpad(key, 20, "0")).alias("process_number"),
        F.to_date("o_orderdate").alias("filed_on"), key.alias("hit_id"),
        F.when((priority == "5-LOW") & (status == "O"), F.lit("outro")).otherwise(key).alias("source_id"),
        F.when((status == "P") & (priority == "2-HIGH"), "TJSP").otherwise("TJGO").alias("tribunal"),
    )
    groups = standins.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("alias"), F.lit("TJGO").alias("expected_tribunal"), F.lit("1995-02-01").cast("date").alias("filed_from"),
        F.lit("2001-07-01").cast("date").alias("filed_to"),
    )
    out = U.quality_assessment(hits, groups, "alias")
    return out.withColumns({n: F.col(n).cast("string") for n in ("min_date", "max_date")})


_GRID = """WITH a AS (SELECT o_custkey AS alias, o_orderpriority AS capability, CASE o_orderstatus WHEN 'F' THEN 'VALIDATED' WHEN 'O' THEN 'INCONCLUSIVE' ELSE 'INCOMPATIBLE' END AS state FROM orders),
r AS (SELECT DISTINCT o_custkey AS alias, o_orderpriority AS capability FROM orders WHERE o_totalprice > 450000),
c AS (SELECT alias, capability, count(*) AS n, CASE WHEN bool_or(state = 'INCOMPATIBLE') THEN 'INCOMPATIBLE' WHEN bool_or(state = 'VALIDATED') THEN 'VALIDATED' ELSE 'INCONCLUSIVE' END AS s FROM a GROUP BY 1, 2),
cells AS (SELECT c_custkey AS alias, p.capability, CASE WHEN r.alias IS NOT NULL THEN 'VALIDATED' ELSE coalesce(s, 'NOT_RUN') END AS state, coalesce(n, 0) AS attempt_count, r.alias IS NOT NULL AS resolved
  FROM customer CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) p(capability)
  LEFT JOIN c ON c.alias = c_custkey AND c.capability = p.capability LEFT JOIN r ON r.alias = c_custkey AND r.capability = p.capability)"""

_CAPABILITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _cells(spark, sf_dir):
    orders = standins.read(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    attempts = orders.select(
        F.col("o_custkey").alias("alias"), F.col("o_orderpriority").alias("capability"),
        F.when(status == "F", U.VALIDATED).when(status == "O", U.INCONCLUSIVE).otherwise(U.INCOMPATIBLE).alias("state"),
    )
    resolutions = orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("alias"), F.col("o_orderpriority").alias("capability"))
    rows = standins.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("alias"))
    grid = U.evidence_grid(rows, "alias", _CAPABILITIES, "capability")
    return U.capability_cells(grid, attempts, resolutions, "alias", "capability")


@query("evidence_matrix", _GRID + " SELECT * FROM cells")
def evidence_matrix(spark, sf_dir):
    """Every source under every capability with its rolled-up evidence."""
    return _cells(spark, sf_dir)


@query("evidence_rows", _GRID + """ SELECT alias, CASE WHEN bool_or(state = 'INCOMPATIBLE') THEN 'INCOMPATIBLE' WHEN bool_and(state = 'VALIDATED') THEN 'VALIDATED'
  WHEN bool_and(state = 'NOT_RUN') THEN 'NOT_RUN' ELSE 'INCONCLUSIVE' END AS row_state, count(*) AS cells FROM cells GROUP BY 1""")
def evidence_rows(spark, sf_dir):
    """The state of each source over its capabilities."""
    return U.row_states(_cells(spark, sf_dir), "alias")


@query("evidence_complete", _GRID + """ SELECT bool_and(state = 'VALIDATED') AND count(*) = 5 * (SELECT count(*) FROM customer) AS complete FROM cells""")
def evidence_complete(spark, sf_dir):
    """Whether the whole matrix is validated."""
    cells = _cells(spark, sf_dir)
    rows = standins.read(spark, sf_dir, "customer").count()
    return U.is_complete(cells, cells, rows, len(_CAPABILITIES), len(_CAPABILITIES), "alias")


_PAIRS = """WITH a AS (SELECT o_custkey AS alias, o_orderpriority AS preset_id, CASE o_orderstatus WHEN 'F' THEN 'NOT_APPLICABLE' ELSE 'APPLICABLE' END AS app,
  CASE o_orderstatus WHEN 'F' THEN 'NOT_APPLICABLE' WHEN 'O' THEN 'VALIDATED' ELSE 'NOT_RUN' END AS state,
  o_orderdate >= '1996-01-01' AS c, o_totalprice > 50000 AS p, o_totalprice < 400000 AS t FROM orders)"""


def _pair_attempts(spark, sf_dir):
    status = F.col("o_orderstatus")
    return standins.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("attempt"), F.col("o_custkey").alias("alias"), F.col("o_orderpriority").alias("preset_id"),
        F.when(status == "F", U.NOT_APPLICABLE).otherwise(U.APPLICABLE).alias("applicability_state"),
        F.when(status == "F", U.NOT_APPLICABLE).when(status == "O", U.VALIDATED).otherwise(U.NOT_RUN).alias("state"),
        F.when(F.col("o_orderdate") >= "1996-01-01", "c2").otherwise("c1").alias("catalog_version"),
        F.when(F.col("o_totalprice") > 50000, "p2").otherwise("p1").alias("preset_version"),
        F.when(F.col("o_totalprice") < 400000, "t2").alias("tpu_version"),
    )



def _reasons():
    return U.stale_reasons({"catalog_version": F.lit("c2"), "preset_version": F.lit("p2"), "tpu_version": F.lit("t2")})


@query("pair_staleness", """SELECT o_orderkey AS attempt, concat_ws(',', CASE WHEN o_orderdate < '1996-01-01' THEN 'CATALOG_VERSION_CHANGED' END,
  CASE WHEN o_totalprice <= 50000 THEN 'PRESET_VERSION_CHANGED' END, CASE WHEN o_totalprice >= 400000 THEN 'TPU_VERSION_CHANGED' END) AS reasons FROM orders""")
def pair_staleness(spark, sf_dir):
    """Why an attempt no longer counts."""
    return _pair_attempts(spark, sf_dir).select("attempt", F.array_join(_reasons(), ",").alias("reasons"))


@query("pair_matrix", _PAIRS + """, cur AS (SELECT * FROM a WHERE c AND p AND t),
roll AS (SELECT alias, preset_id, count(*) AS n, CASE WHEN bool_and(state = 'NOT_APPLICABLE') THEN 'NOT_APPLICABLE' WHEN bool_or(state = 'NOT_APPLICABLE') THEN 'INCOMPATIBLE'
  WHEN bool_or(state = 'VALIDATED') THEN 'VALIDATED' ELSE 'NOT_RUN' END AS s, CASE WHEN min(app) = max(app) THEN min(app) ELSE 'INCONCLUSIVE' END AS app FROM cur GROUP BY 1, 2)
SELECT c_custkey AS alias, p.preset_id, coalesce(s, 'NOT_RUN') AS state, coalesce(n, 0) AS attempt_count, coalesce(app, 'NOT_RUN') AS applicability
FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority AS preset_id FROM orders) p LEFT JOIN roll r ON r.alias = c_custkey AND r.preset_id = p.preset_id""")
def pair_matrix(spark, sf_dir):
    """Every source under every preset from its current attempts."""
    current = _pair_attempts(spark, sf_dir).where(F.size(_reasons()) == 0)
    rows = standins.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("alias"))
    grid = U.evidence_grid(rows, "alias", _CAPABILITIES, "preset_id")
    cells = U.capability_cells(grid, current, current.where("false"), "alias", "preset_id", allow_not_applicable=True)
    agreed = U.applicability_consensus(current, ["alias", "preset_id"])
    return cells.join(agreed, ["alias", "preset_id"], "left").select(
        "alias", "preset_id", "state", "attempt_count", F.coalesce("applicability", F.lit(U.NOT_RUN)).alias("applicability")
    )


@query("pair_states", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'APPLICABLE' WHEN 'A' THEN 'NOT_APPLICABLE' ELSE 'INCONCLUSIVE' END AS a,
  CASE WHEN l_quantity < 20 THEN 'VALIDATED' WHEN l_quantity < 30 THEN 'INCOMPATIBLE' WHEN l_quantity < 40 THEN 'NOT_RUN' ELSE 'INCONCLUSIVE' END AS q,
  CASE WHEN l_discount < 0.055 THEN 'VALIDATED' ELSE 'INCONCLUSIVE' END AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a = 'NOT_APPLICABLE' THEN a WHEN a <> 'APPLICABLE' THEN 'INCONCLUSIVE' WHEN q = 'INCOMPATIBLE' THEN q
  WHEN q = 'VALIDATED' AND m = 'VALIDATED' THEN q WHEN q = 'NOT_RUN' THEN q ELSE 'INCONCLUSIVE' END AS pair_state FROM s""")
def pair_states(spark, sf_dir):
    """One state from applicability, query and sample."""
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
    applicability = F.when(flag == "R", U.APPLICABLE).when(flag == "A", U.NOT_APPLICABLE).otherwise(U.INCONCLUSIVE)
    asked = F.when(quantity < 20, U.VALIDATED).when(quantity < 30, U.INCOMPATIBLE).when(quantity < 40, U.NOT_RUN).otherwise(U.INCONCLUSIVE)
    sample = F.when(F.col("l_discount") < 0.055, U.VALIDATED).otherwise(U.INCONCLUSIVE)
    line = standins.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", applicability.alias("a"), asked.alias("q"), sample.alias("s")
    )
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", U.pair_state(F.col("a"), F.col("q"), F.col("s")).alias("pair_state")
    )


@query("attempt_dedupe", """SELECT l_orderkey AS run_id, l_linenumber AS alias, count(*) AS reports, min(l_partkey) AS digest, min(l_partkey) <> max(l_partkey) AS divergent
FROM lineitem GROUP BY 1, 2""")
def attempt_dedupe(spark, sf_dir):
    """Attempts reported more than once, and whether their reports diverge."""
    line = standins.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("alias"), "l_partkey")
    return U.deduplicated_attempts(line, ["run_id", "alias"], "l_partkey")


@query("request_totals", """WITH s AS (SELECT l_orderkey, sum(l_linenumber)::BIGINT AS observed FROM lineitem GROUP BY 1)
SELECT o_orderkey AS run_id, o_custkey AS declared, coalesce(observed, 0) AS observed FROM orders LEFT JOIN s ON l_orderkey = o_orderkey WHERE o_custkey <> coalesce(observed, 0)""")
def request_totals(spark, sf_dir):
    """Batches whose declared total is not the sum of their parts."""
    declared = standins.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("requests"))
    observed = standins.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("requests"))
    return U.request_total_mismatches(declared, observed, "run_id")


@query("batch_exceptions", """WITH f AS (SELECT l_orderkey, coalesce(string_agg(CASE WHEN l_linestatus = 'O' THEN 'q' || l_linenumber END, ',' ORDER BY 'q' || l_linenumber), '') AS failed_requests,
    coalesce(string_agg(CASE WHEN l_linestatus = 'F' THEN 'p' || l_partkey || ':q' || l_linenumber END, ',' ORDER BY 'p' || l_partkey || ':q' || l_linenumber), '') AS failed_pair_requests
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
n AS (SELECT l_orderkey, string_agg('p' || l_partkey, ',' ORDER BY 'p' || l_partkey) AS pairs_not_run FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'budget' END AS stop_reason, failed_requests, failed_pair_requests, pairs_not_run
FROM orders LEFT JOIN f ON f.l_orderkey = o_orderkey LEFT JOIN n ON n.l_orderkey = o_orderkey
WHERE failed_requests IS NOT NULL OR pairs_not_run IS NOT NULL OR o_orderstatus = 'P'""")
def batch_exceptions(spark, sf_dir):
    """Failed requests, pairs that were not run, and early stops per report."""
    line = standins.read(spark, sf_dir, "lineitem").withColumns({"run_id": F.col("l_orderkey"), "alias": F.lit("tjgo")})
    preset = F.concat(F.lit("p"), "l_partkey")
    requests = line.select(
        "run_id", "alias", F.when(F.col("l_linestatus") == "F", preset).alias("preset_id"), F.concat(F.lit("q"), "l_linenumber").alias("name"),
        F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("OK").alias("outcome"),
    )
    pairs = line.select("run_id", "alias", preset.alias("preset_id"), F.when(F.col("l_quantity") > 45, U.NOT_RUN).otherwise(U.VALIDATED).alias("pair_state"))
    reports = standins.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.lit("tjgo").alias("alias"), F.when(F.col("o_orderstatus") == "P", "budget").alias("stop_reason")
    )
    return U.batch_exceptions(reports, requests, pairs).drop("alias")


@query("percentile_lower", """SELECT event_type, list_sort(list(value))[((count(value) - 1) * 0.5)::DOUBLE::INT + 1] AS p50x,
  list_sort(list(value))[floor((count(value) - 1) * 0.5)::INT + 1] AS p50, list_sort(list(value))[floor((count(value) - 1) * 0.95)::INT + 1] AS p95
FROM events GROUP BY 1""".replace("list_sort(list(value))[((count(value) - 1) * 0.5)::DOUBLE::INT + 1] AS p50x,\n  ", ""))
def percentile_lower(spark, sf_dir):
    """Exact percentiles at the lower index."""
    events = standins.read(spark, sf_dir, "events").select("event_type", "value")
    return U.lower_percentiles(events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("run_profiles", """WITH n AS (SELECT c_nationkey AS page_size, count(*) AS runs, avg(c_acctbal) AS m, bool_and(c_acctbal > -990) AS sound FROM customer GROUP BY 1),
need AS (SELECT max(runs) AS k FROM n)
SELECT page_size, runs, CASE WHEN runs = k THEN round(m, 2) END AS mean_hits_per_minute,
  CASE WHEN runs <> k THEN 'INCONCLUSIVE' WHEN sound THEN 'PASS' ELSE 'FAIL' END AS integrity FROM n, need""")
def run_profiles(spark, sf_dir):
    """Mean throughput and integrity per profile with the full number of repetitions."""
    customers = standins.read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("page_size"), F.col("c_acctbal").alias("hits_per_minute"), (F.col("c_acctbal") > -990).alias("sound")
    )
    repetitions = customers.groupBy("page_size").count().agg(F.max("count")).first()[0]
    return U.run_profiles(customers, repetitions).withColumn("mean_hits_per_minute", F.round("mean_hits_per_minute", 2))


@query("profile_best", """WITH n AS (SELECT c_nationkey AS page_size, avg(c_acctbal) AS m FROM customer GROUP BY 1)
SELECT page_size AS selected_profile FROM n ORDER BY m DESC, page_size LIMIT 1""")
def profile_best(spark, sf_dir):
    """The sound profile with the highest mean."""
    means = standins.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("page_size")).agg(
        F.avg("c_acctbal").alias("mean_hits_per_minute")
    )
    return U.best_profile(means.withColumn("integrity", F.lit("PASS")))
