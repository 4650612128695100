"""Overview, facets, summaries, paged lists and the export over the case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.operators import analytics as A
from docketflow.operators import export as E
from docketflow.operators import ordered as O
from docketflow.operators import signals as S
from docketflow.operators.filters import ProcessFilters, select_processes
from docketflow.plans import standins
from docketflow.plans.registry import query
from docketflow.plans.sqlparts import CASES, REP, ROW_KEY, TRIBUNAL_LIST

_OVERVIEW = """
SELECT (SELECT count(DISTINCT process_id) FROM chosen) AS process_count,
  count(DISTINCT r.representation_id) AS representation_count,
  count(DISTINCT c.process_id) FILTER (coalesce(t.decision, 'pending') = 'pending') AS triage_pending,
  count(DISTINCT c.process_id) FILTER (coalesce(t.decision, 'pending') = 'relevant') AS triage_relevant,
  count(DISTINCT c.process_id) FILTER (coalesce(t.decision, 'pending') = 'discarded') AS triage_discarded,
  (SELECT count(DISTINCT process_id) FROM watchlist WHERE active AND process_id IN (SELECT process_id FROM chosen)) AS followed_process_count,
  (SELECT count(*) FROM news WHERE status = 'pending' AND process_id IN (SELECT process_id FROM chosen)) AS pending_news_count,
  strftime(max(r.last_observed_at), '%Y-%m-%d') AS latest_observation_at
FROM chosen c LEFT JOIN triage t ON t.process_id = c.process_id
"""


def _with_text_date(df):
    return df.withColumn("latest_observation_at", F.date_format("latest_observation_at", "yyyy-MM-dd"))


@query("overview_stats", f"""WITH {CASES}, chosen AS (SELECT process_id FROM processes)
{_OVERVIEW} LEFT JOIN representations r ON r.process_id = c.process_id""")
def overview_stats(spark, sf_dir):
    """Headline counts over all processes."""
    return _with_text_date(A.overview_statistics(standins.case_tables(spark, sf_dir), ProcessFilters()))


@query("overview_stats_cut", f"""WITH {CASES}, chosen AS (
  SELECT process_id FROM processes p WHERE EXISTS (
    SELECT 1 FROM representations r WHERE r.process_id = p.process_id
      AND r.tribunal IN ('TJBA','TJGO','TJMG','TJSP','TJRS','TJPA')
      AND EXISTS (SELECT 1 FROM subjects s WHERE s.representation_id = r.representation_id AND s.subject_name = 'PROMO'))
  AND (EXISTS (SELECT 1 FROM triage t WHERE t.process_id = p.process_id AND t.decision = 'pending')
       OR NOT EXISTS (SELECT 1 FROM triage t WHERE t.process_id = p.process_id)))
{_OVERVIEW} LEFT JOIN representations r ON r.process_id = c.process_id
  AND r.tribunal IN ('TJBA','TJGO','TJMG','TJSP','TJRS','TJPA')""")
def overview_stats_cut(spark, sf_dir):
    """The same counts under a cut by tribunal, subject and implicit decision."""
    filters = ProcessFilters(
        tribunals=("tjba", "TJGO", "tjmg", "TJSP", "TJRS", "TJPA"), subject_name_exact="PROMO", decision="pending"
    )
    return _with_text_date(A.overview_statistics(standins.case_tables(spark, sf_dir), filters))


@query("signal_distribution", f"""WITH {CASES}
SELECT category, count(DISTINCT process_id) AS process_count FROM live_signals
WHERE process_id IN (SELECT process_id FROM processes) GROUP BY category""")
def signal_distribution(spark, sf_dir):
    """Processes per category of current signals."""
    return A.signal_distribution(standins.case_tables(spark, sf_dir), ProcessFilters())


@query("theme_distribution", f"""WITH {CASES}
SELECT subject_code, subject_name, count(DISTINCT process_id) AS process_count FROM subjects
WHERE process_id IN (SELECT process_id FROM processes) GROUP BY 1, 2""")
def theme_distribution(spark, sf_dir):
    """Processes per subject."""
    return A.theme_distribution(standins.case_tables(spark, sf_dir), ProcessFilters())


@query("facet_subject", f"""WITH {CASES}, candidates AS (
  SELECT subject_name AS value, process_id FROM subjects UNION ALL SELECT subject_code, process_id FROM subjects)
SELECT value, value AS label, count(DISTINCT process_id) AS process_count FROM candidates
WHERE trim(value) <> '' AND (contains(lower(value), 'brand#1') OR value = 'PROMO')
GROUP BY value ORDER BY (value <> 'PROMO'), process_count DESC, value LIMIT 20""")
def facet_subject(spark, sf_dir):
    """Subject names and codes that match a text without case and accents, the selected one first."""
    return A.facet_options(standins.case_tables(spark, sf_dir), "subject", query=" BRÁND#1", selected="PROMO")


@query("facet_court_unit", f"""WITH {CASES}, candidates AS (
  SELECT court_unit_name AS value, process_id FROM representations
  UNION ALL SELECT court_unit_code, process_id FROM representations)
SELECT value, value AS label, count(DISTINCT process_id) AS process_count FROM candidates
GROUP BY value ORDER BY process_count DESC, value LIMIT 10""")
def facet_court_unit(spark, sf_dir):
    """The ten most common court units by name or code."""
    return A.facet_options(standins.case_tables(spark, sf_dir), "court_unit")


@query("facet_preset", f"""WITH {CASES}, candidates AS (
  SELECT preset_id AS value, process_id FROM results JOIN runs USING (collection_id))
SELECT value, CASE WHEN value = 'tema.primeiro' THEN 'Crédito rural' WHEN value LIKE 'custom:%' THEN 'Busca personalizada'
  ELSE 'Tema histórico' END AS label, count(DISTINCT process_id) AS process_count
FROM candidates WHERE value <> 'antigo' GROUP BY value""")
def facet_preset(spark, sf_dir):
    """Presets found by their id or by their label."""
    return A.facet_options(
        standins.case_tables(spark, sf_dir), "preset_id", query="credito", selected="custom:segundo",
        preset_names={"tema.primeiro": "Crédito rural"},
    )


@query("facet_case_number", f"""WITH {CASES}
SELECT process_number AS value, substr(process_number, 1, 7) || '-' || substr(process_number, 8, 2) || '.'
  || substr(process_number, 10, 4) || '.' || substr(process_number, 14, 1) || '.' || substr(process_number, 15, 2) || '.'
  || substr(process_number, 17, 4) AS label, 1::BIGINT AS process_count
FROM processes WHERE contains(process_number, '0012') ORDER BY process_number LIMIT 20""")
def facet_case_number(spark, sf_dir):
    """Case numbers that contain the digits of a query."""
    return A.facet_options(standins.case_tables(spark, sf_dir), "process_number", query="00-12")


@query("facet_collections", f"""WITH {CASES}, counts AS (
  SELECT collection_id, count(DISTINCT process_id) AS process_count FROM results GROUP BY 1),
named AS (
  SELECT c.collection_id AS value, c.created_at, process_count,
    strftime(c.created_at - INTERVAL 3 HOUR, '%d/%m/%Y') AS local_day,
    CASE WHEN m = 12 THEN 'Definição histórica' ELSE 'Créditos ' || lpad(m::VARCHAR, 2, '0') END AS theme,
    CASE status WHEN 'completed' THEN 'Concluída' WHEN 'partial' THEN 'Parcial' WHEN 'failed' THEN 'Falhou' ELSE 'Na fila' END AS status_label
  FROM collections c JOIN counts USING (collection_id) JOIN runs USING (collection_id))
SELECT value, theme || ' · ' || status_label AS label,
  process_count || CASE WHEN process_count = 1 THEN ' processo' ELSE ' processos' END AS detail, process_count
FROM named WHERE status_label = 'Concluída' OR value = '1999-12'
ORDER BY (value <> '1999-12'), created_at DESC, value DESC LIMIT 20""")
def facet_collections(spark, sf_dir):
    """Collections by theme, status or time, matched on the text of the group's labels."""
    options = A.collection_options(standins.case_tables(spark, sf_dir), query="CONCLUIDA", selected="1999-12")
    # The local time depends on the zone's clock changes; the rest of the label is compared.
    return options.withColumn("label", F.regexp_replace("label", "^[^·]*· ", ""))


@query("latest_collections", f"""WITH {CASES}
SELECT collection_id, run_id, status, strftime(created_at, '%Y-%m-%d') AS created_at FROM runs
ORDER BY runs.created_at DESC, run_id DESC LIMIT 5""")
def latest_collections(spark, sf_dir):
    """The five most recent collection runs."""
    out = A.latest_collections(standins.runs(spark, sf_dir))
    return out.select("collection_id", "run_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


@query("process_summaries", f"""WITH {CASES}, counts AS (
  SELECT process_id, count(*) AS representation_count, max(last_observed_at) AS latest_observed_at
  FROM representations GROUP BY 1),
newest AS (
  SELECT process_id, collection_id, capture_outcome, status FROM results JOIN runs USING (collection_id)
  QUALIFY row_number() OVER (PARTITION BY process_id ORDER BY included_at DESC, representation_id DESC) = 1)
SELECT p.process_id, coalesce(representation_count, 0) AS representation_count,
  strftime(latest_observed_at, '%Y-%m-%d') AS latest_observed_at, collection_id AS latest_collection_id, capture_outcome,
  status AS run_status, coalesce(decision, 'pending') AS decision
FROM processes p LEFT JOIN counts USING (process_id) LEFT JOIN newest USING (process_id) LEFT JOIN triage USING (process_id)""")
def process_summaries(spark, sf_dir):
    """One summary row per process with its latest collection."""
    tables = standins.case_tables(spark, sf_dir)
    out = A.process_summaries(tables, tables.processes)
    return out.select(
        "process_id", "representation_count", F.date_format("latest_observed_at", "yyyy-MM-dd").alias("latest_observed_at"),
        "latest_collection_id", "capture_outcome", "run_status", "decision",
    )


@query("process_page", f"""WITH {CASES}
SELECT process_id, process_number FROM processes ORDER BY process_number, process_id LIMIT 20 OFFSET 40""")
def process_page(spark, sf_dir):
    """The third page of twenty processes."""
    rows = standins.processes(spark, sf_dir).select("process_id", "process_number")
    return A.page_of(rows, 3, 20, F.col("process_number"), F.col("process_id"))


@query("process_page_totals", f"""WITH {CASES}
SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM processes""")
def process_page_totals(spark, sf_dir):
    """Row and page counts beside the list."""
    return A.page_totals(standins.processes(spark, sf_dir), 20)


@query("keyset_page", """SELECT o_custkey, o_orderkey FROM orders
WHERE o_custkey > 7 OR (o_custkey = 7 AND o_orderkey > 100) ORDER BY o_custkey, o_orderkey LIMIT 50""")
def keyset_page(spark, sf_dir):
    """Fifty orders after a cursor."""
    rows = standins.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return A.keyset_page(rows, "o_custkey", "o_orderkey", (7, 100), 50)


@query("representation_list", f"""WITH {CASES}
SELECT representation_id, tribunal, court_unit_code FROM representations ORDER BY tribunal, representation_id LIMIT 100""")
def representation_list(spark, sf_dir):
    """The first hundred representations by source, tribunal and id."""
    rows = standins.representations(spark, sf_dir)
    return A.page_of(rows, 1, 100, F.col("source"), F.col("tribunal"), F.col("representation_id")).select(
        "representation_id", "tribunal", "court_unit_code"
    )


@query("movement_timeline", f"""SELECT {ROW_KEY} AS movement_id,
  CASE WHEN l_returnflag <> 'N' THEN strftime(l_shipdate, '%Y-%m-%d') END AS source_date FROM lineitem
ORDER BY CASE WHEN l_returnflag <> 'N' THEN l_shipdate END ASC NULLS LAST, movement_id LIMIT 100""")
def movement_timeline(spark, sf_dir):
    """Movements by source date, undated ones last."""
    dated = F.when(F.col("l_returnflag") != "N", F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = standins.read(spark, sf_dir, "lineitem").select(standins.row_key().alias("movement_id"), dated.alias("source_date"))
    return A.page_of(rows, 1, 100, F.asc_nulls_last("source_date"), F.col("movement_id"))


@query("news_feed", f"""WITH {CASES}
SELECT news_id, process_id, strftime(first_observed_at, '%Y-%m-%d') AS day FROM news
WHERE status = 'pending' AND category = 'NEW_OBSERVATION'
  AND process_id IN (SELECT process_id FROM triage WHERE decision = 'relevant')
ORDER BY first_observed_at DESC, news_id DESC LIMIT 100""")
def news_feed(spark, sf_dir):
    """Pending observations of relevant processes, newest first."""
    tables = standins.case_tables(spark, sf_dir)
    chosen = select_processes(tables, ProcessFilters(decision="relevant"))
    feed = A.news_feed(tables.news, status="pending", category="NEW_OBSERVATION", chosen=chosen)
    return feed.limit(100).select("news_id", "process_id", F.date_format("first_observed_at", "yyyy-MM-dd").alias("day"))


@query("run_list", f"""WITH {CASES}
SELECT run_id, status, kind FROM runs WHERE status = 'partial' AND kind = 'collect_preset'""")
def run_list(spark, sf_dir):
    """Runs of one kind and status."""
    return A.run_list(standins.runs(spark, sf_dir), "partial", "collect_preset").select("run_id", "status", "kind")


@query("signal_list", f"""WITH {CASES}
SELECT signal_id, is_current, category,
  CASE WHEN rule_version = '1.0.0' THEN 'Regra ' || rule_id ELSE rule_id END AS rule_name
FROM signals WHERE is_published AND is_current""")
def signal_list(spark, sf_dir):
    """Published, current signals named by the rule list of their run."""
    signals = standins.signals(spark, sf_dir).withColumn("run_id", F.lit("run-1"))
    rules = standins.rules_frame(spark).select(
        F.lit("run-1").alias("run_id"), "rule_id", "rule_version", F.concat(F.lit("Regra "), "rule_id").alias("rule_name")
    )
    shown = S.signal_list(signals, rules, current_only=True)
    return shown.select("signal_id", "is_current", "category", "rule_name")


@query("export_rows", f"""WITH {CASES}, chosen AS (
  SELECT p.* FROM processes p WHERE process_id IN (SELECT process_id FROM watchlist WHERE active)),
lists AS (
  SELECT process_id, string_agg(DISTINCT tribunal, '; ' ORDER BY tribunal) AS tribunal,
    string_agg(DISTINCT class_name || ' (' || class_code || ')', '; ' ORDER BY class_name || ' (' || class_code || ')') AS classes,
    string_agg(DISTINCT grau, '; ' ORDER BY grau) AS graus,
    string_agg(DISTINCT court_unit_name || ' (' || court_unit_code || ')', '; ' ORDER BY court_unit_name || ' (' || court_unit_code || ')') AS orgaos,
    min(created_at) AS first_created, max(last_observed_at) AS last_observed
  FROM representations GROUP BY 1),
subject_lists AS (
  SELECT process_id, string_agg(DISTINCT subject_name || ' (' || subject_code || ')', '; ' ORDER BY subject_name || ' (' || subject_code || ')') AS assuntos
  FROM subjects GROUP BY 1),
first_seen AS (SELECT l_orderkey AS process_id, min(l_shipdate) AS first_observed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
reasons AS (
  SELECT process_id, string_agg(DISTINCT 'Assunto do mês ' || substr(collection_id, 6, 2), '; ' ORDER BY 'Assunto do mês ' || substr(collection_id, 6, 2)) AS motivos
  FROM results WHERE substr(collection_id, 6, 2) <> '12' GROUP BY 1)
SELECT process_number AS numero_cnj, coalesce(tribunal, '') AS tribunal, coalesce(classes, '') AS classes, coalesce(graus, '') AS graus,
  coalesce(orgaos, '') AS orgaos, coalesce(assuntos, '') AS assuntos,
  CASE coalesce(decision, 'pending') WHEN 'pending' THEN 'Pendente' WHEN 'relevant' THEN 'Relevante' ELSE 'Descartado' END AS triagem,
  CASE coalesce(rural_link, 'unconfirmed') WHEN 'confirmed' THEN 'Confirmado' ELSE 'Não confirmado' END AS vinculo_rural,
  coalesce(motivos, '') AS motivos_captura, 'Sim' AS acompanhado,
  coalesce(strftime(coalesce(first_observed, first_created), '%Y-%m-%dT%H:%M:%SZ'), '') AS primeira_observacao,
  coalesce(strftime(last_observed, '%Y-%m-%dT%H:%M:%SZ'), '') AS ultima_observacao, 'demo' AS data_source,
  '2026-01-01T00:00:00Z' AS exportado_em
FROM chosen LEFT JOIN lists USING (process_id) LEFT JOIN subject_lists USING (process_id) LEFT JOIN first_seen USING (process_id)
LEFT JOIN reasons USING (process_id) LEFT JOIN triage USING (process_id)""")
def export_rows(spark, sf_dir):
    """The export of all followed processes."""
    tables = standins.case_tables(spark, sf_dir)
    observed = standins.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        standins.representation_key().alias("representation_id"), F.col("l_shipdate").cast("timestamp").alias("observed_at")
    )
    rows = E.export_rows(tables, observed, ProcessFilters(followed=True), "2026-01-01T00:00:00Z")
    return rows.select(*E.HEADERS)


@query("discovery_reasons", f"""WITH {CASES}, first_code AS (
  SELECT representation_id, process_id, collection_id, substr(collection_id, 6, 2)::INT AS m FROM results),
held AS (SELECT DISTINCT {REP} AS representation_id, l_linenumber AS code FROM lineitem),
texts AS (
  SELECT DISTINCT f.representation_id,
    CASE WHEN a.code IS NOT NULL AND b.code IS NOT NULL THEN 'Assunto ' || (m % 7 + 1) || ' — Linha + Assunto ' || (m % 7 + 8) || ' — Outra'
         WHEN a.code IS NOT NULL THEN 'Assunto ' || (m % 7 + 1) || ' — Linha'
         WHEN b.code IS NOT NULL THEN 'Assunto ' || (m % 7 + 8) || ' — Outra'
         ELSE 'Critério consultado: Assunto ' || (m % 7 + 1) || ' — Linha; Assunto ' || (m % 7 + 8)
           || ' — Outra (a captura não preserva código estruturado correspondente)' END AS reason
  FROM first_code f LEFT JOIN held a ON a.representation_id = f.representation_id AND a.code = m % 7 + 1
  LEFT JOIN held b ON b.representation_id = f.representation_id AND b.code = m % 7 + 8)
SELECT representation_id, reason FROM texts""")
def discovery_reasons(spark, sf_dir):
    """Which of a query's codes the stored payload really carries."""
    included = standins.results(spark, sf_dir).select(
        "representation_id", "collection_id", F.col("representation_id").alias("version_id")
    )
    number = F.substring("collection_id", 6, 2).cast("int") % 7
    explanations = standins.collections(spark, sf_dir).select(
        "collection_id", F.lit("subject").alias("dimension"),
        F.explode(F.array(
            F.struct((number + 1).cast("string").alias("code"), F.lit("Linha").alias("name")),
            F.struct((number + 8).cast("string").alias("code"), F.lit("Outra").alias("name")),
        )).alias("c"),
    ).select("collection_id", "dimension", "c.*")
    observed = standins.read(spark, sf_dir, "lineitem").select(
        standins.representation_key().alias("version_id"), F.lit("subject").alias("dimension"),
        F.col("l_linenumber").cast("string").alias("code"),
    ).distinct()
    return A.discovery_reasons(included, explanations, observed)


@query("refresh_targets", f"""WITH {CASES} SELECT DISTINCT p.process_id, coalesce(r.tribunal, 'TJGO') AS tribunal
FROM processes p LEFT JOIN representations r ON r.process_id = p.process_id AND r.tribunal <> 'TJAC'""")
def refresh_targets(spark, sf_dir):
    """The tribunals to ask for each process; representations of another source don't count."""
    source = F.when(F.col("tribunal") == "TJAC", "other").otherwise("synthetic")
    return A.refresh_targets(standins.processes(spark, sf_dir), standins.representations(spark, sf_dir).withColumn("source", source), "synthetic")


@query("watch_list", f"""WITH {CASES} SELECT process_id FROM watchlist WHERE active ORDER BY included_at DESC, process_id LIMIT 100 OFFSET 100""")
def watch_list(spark, sf_dir):
    """The second page of the watch list."""
    return A.watch_list(standins.case_tables(spark, sf_dir).watchlist, 2, 100).select("process_id")


@query("definition_list", """SELECT o_orderkey AS definition_id FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def definition_list(spark, sf_dir):
    """The first hundred saved definitions that are not archived."""
    rows = standins.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("definition_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("archived_at"),
    )
    return A.definition_list(rows, 1, 100).select("definition_id")


@query("decision_page", """WITH busiest AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS version, o_orderstatus AS decision FROM orders WHERE o_custkey = (SELECT o_custkey FROM busiest)
ORDER BY version DESC LIMIT 10 OFFSET 10""")
def decision_page(spark, sf_dir):
    """The second page of the longest decision history, the newest version first."""
    log = standins.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("process_id"), F.col("o_orderstatus").alias("decision"), "o_orderdate", "o_orderkey")
    bucket = O.time_bucket(F.col("o_orderdate").cast("timestamp"))
    history = O.running_totals(log, ["process_id"], ["o_orderdate", "o_orderkey"], bucket, {"version": F.lit(1)})
    sizes = log.groupBy("process_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "process_id").limit(1)
    return A.decision_page(history, sizes.select("process_id").scalar(), 2, 10).select("version", "decision")
