"""SQL fragments shared by the oracle statements."""

from __future__ import annotations

from docketflow.sources.reference import TRIBUNALS

TRIBUNAL_LIST = "[" + ", ".join(f"'{name}'" for name in TRIBUNALS) + "]"

REP = "(l_orderkey::VARCHAR || '-' || l_suppkey::VARCHAR)"
ROW_KEY = "(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR)"

CASES = f"""
processes AS (
  SELECT o_orderkey AS process_id, lpad(o_orderkey::VARCHAR, 20, '0') AS process_number, o_orderdate AS created_at
  FROM orders),
representations AS (
  SELECT l_orderkey AS process_id, {REP} AS representation_id,
         {TRIBUNAL_LIST}[min(s_nationkey) + 1] AS tribunal,
         min(l_returnflag) AS class_code, 'Classe ' || min(l_returnflag) AS class_name, max(l_linestatus) AS grau,
         l_suppkey::VARCHAR AS court_unit_code, min(s_name) AS court_unit_name,
         min(l_shipdate) AS created_at, max(l_shipdate) AS last_observed_at
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey, l_suppkey),
subjects AS (
  SELECT l_orderkey AS process_id, {REP} AS representation_id, p_brand AS subject_code, p_type AS subject_name
  FROM lineitem JOIN part ON l_partkey = p_partkey),
triage AS (
  SELECT o_orderkey AS process_id,
         CASE o_orderstatus WHEN 'F' THEN 'discarded' WHEN 'O' THEN 'relevant' ELSE 'pending' END AS decision,
         CASE WHEN o_totalprice > 200000 THEN 'confirmed' ELSE 'unconfirmed' END AS rural_link
  FROM orders WHERE o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW')),
watchlist AS (
  SELECT o_orderkey AS process_id, o_orderpriority = '1-URGENT' AS active, o_orderdate AS included_at FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
news AS (
  SELECT {ROW_KEY} AS news_id, l_orderkey AS process_id, {REP} AS representation_id,
         CASE WHEN l_linestatus = 'O' THEN 'NEW_OBSERVATION' ELSE 'ALTERATION_OBSERVED' END AS category,
         CASE WHEN l_returnflag = 'R' THEN 'pending' ELSE 'seen' END AS status, l_shipdate AS first_observed_at
  FROM lineitem WHERE l_returnflag <> 'N'),
signals AS (
  SELECT {ROW_KEY} AS signal_id, l_orderkey AS process_id,
         CASE WHEN l_returnflag = 'A' THEN 'sinal.leilao' ELSE 'sinal.penhora' END AS rule_id,
         CASE WHEN l_returnflag = 'N' THEN '0.9.0' ELSE '1.0.0' END AS rule_version,
         CASE WHEN l_returnflag = 'A' THEN 'leilao' ELSE 'penhora' END AS category,
         l_tax > 0.015 AS is_published, l_linestatus = 'O' AS is_current, l_discount > 0.055 AS evidence_stale,
         l_shipdate AS evaluated_at
  FROM lineitem),
live_signals AS (
  SELECT * FROM signals WHERE is_published AND is_current
  AND ((rule_id = 'sinal.leilao' AND rule_version = '1.0.0') OR (rule_id = 'sinal.penhora' AND rule_version = '1.0.0'))),
pair_dates AS (
  SELECT {REP} AS representation_id, l_orderkey AS process_id, o_orderdate, min(l_shipdate) AS shipped
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_suppkey, o_orderdate),
collections AS (
  SELECT strftime(d, '%Y-%m') AS collection_id, min(d) AS created_at
  FROM (SELECT o_orderdate AS d FROM orders UNION ALL SELECT shipped FROM pair_dates) GROUP BY 1),
runs AS (
  SELECT 'run-' || collection_id AS run_id, collection_id, created_at, substr(collection_id, 6, 2)::INT AS m,
         CASE WHEN m <= 3 THEN 'completed' WHEN m <= 6 THEN 'partial' WHEN m <= 9 THEN 'failed' ELSE 'queued' END AS status,
         CASE WHEN m % 2 = 0 THEN 'collect_preset' ELSE 'refresh_number' END AS kind,
         {TRIBUNAL_LIST}[m + 1] AS tribunal,
         CASE WHEN m <= 6 THEN 'tema.primeiro' WHEN m <= 11 THEN 'custom:segundo' ELSE 'antigo' END AS preset_id
  FROM collections),
results AS (
  SELECT representation_id, process_id, strftime(o_orderdate, '%Y-%m') AS collection_id, o_orderdate AS included_at,
         'new' AS capture_outcome FROM pair_dates
  UNION ALL
  SELECT representation_id, process_id, strftime(shipped, '%Y-%m'), shipped, 'updated' FROM pair_dates
  WHERE strftime(shipped, '%Y-%m') <> strftime(o_orderdate, '%Y-%m'))
"""

# Line items as hits: which check fails first, and the payload and movements of the sound ones.
HITS = """
raw AS (
  SELECT *, round(l_tax * 100)::INT AS t, round(l_discount * 100)::INT AS d, l_quantity::INT AS q,
         'r' || l_orderkey || '-' || l_linenumber AS id, 'c' || l_orderkey AS collection_id,
         strftime(l_shipdate, '%Y-%m-%d') AS day
  FROM lineitem),
hits AS (
  SELECT *, (q // 10)::INT AS code1, CASE WHEN d % 2 = 0 THEN (q // 10)::INT ELSE (q // 10)::INT + 1 END AS code2,
    CASE WHEN t = 0 THEN 'SOURCE_ID_INVALID' WHEN q = 48 THEN 'HIT_SOURCE_ID_INVALID' WHEN d = 10 THEN 'SOURCE_ID_MISMATCH'
         WHEN q = 50 THEN 'CNJ_INVALID' WHEN q = 49 THEN 'TRIBUNAL_INVALID' END AS validation_code,
    CASE WHEN t = 0 THEN '_source.id' WHEN q = 48 THEN '_id' WHEN d = 10 THEN '_source.id'
         WHEN q = 50 THEN '_source.numeroProcesso' WHEN q = 49 THEN '_source.tribunal' END AS error_path,
    sha256('{"collection_id":"' || collection_id || '","previous_checkpoint_revision":' || l_partkey || '}') AS page_key,
    CASE WHEN l_linestatus = 'F' THEN day || 'T00:00:00-03:00' ELSE strftime(l_shipdate, '%Y%m%d') || '000000' END AS filed,
    md5('synthetic' || chr(1) || 'TJGO' || chr(1) || id) AS representation_id,
    CASE WHEN t = 8 THEN ',"valor":' || l_extendedprice::VARCHAR ELSE '' END AS price_field
  FROM raw),
sound AS (
  SELECT *,
    '{"codigo":' || code1 || ',"complementosTabelados":[{"b":2},{"a":1}],"dataHora":"2020-01-0' || l_linenumber
      || 'T10:00:00Z","extra":' || l_linenumber || ',"nome":"' || l_returnflag || '"' || price_field || '}' AS m1,
    '{"codigo":' || code2 || ',"complementosTabelados":[{"a":1},{"b":2}],"dataHora":"2020-01-0' || l_linenumber
      || 'T10:00:00Z","extra":' || l_linenumber || ',"nome":"' || l_returnflag || '"' || price_field || '}' AS m2,
    CASE t WHEN 1 THEN '' WHEN 2 THEN '"movimentos":null,' WHEN 3 THEN '"movimentos":"nada",' WHEN 4 THEN '"movimentos":[],'
      WHEN 5 THEN '"movimentos":[' || m1 || ',7],' ELSE '"movimentos":[' || m1 || ',' || m2 || '],' END AS array_field,
    '{"@timestamp":"' || day || 'T00:00:00Z","assuntos":[{"codigo":' || l_partkey || ',"nome":"Part ' || l_partkey
      || '"},{"codigo":null},{"nome":"' || l_returnflag || '"}],"classe":{"codigo":' || l_suppkey || ',"nome":" Flag '
      || l_returnflag || ' "},"dataAjuizamento":"' || filed || '","grau":"' || l_linestatus || '","id":"' || id || '",'
      || array_field || '"numeroProcesso":"' || lpad(l_orderkey::VARCHAR, 20, '0')
      || '","orgaoJulgador":{"codigo":"' || l_partkey || '","nome":""},"tribunal":"TJGO"}' AS payload,
    sha256(payload) AS payload_sha256, md5(representation_id || chr(1) || sha256(payload)) AS version_id
  FROM hits WHERE validation_code IS NULL),
versions AS (
  SELECT representation_id, version_id, min(l_shipdate) AS first_at, any_value(t) AS t, any_value(d) AS d,
         any_value(code1) AS code1, any_value(code2) AS code2, any_value(l_returnflag) AS flag,
         any_value(l_linenumber) AS line, any_value(l_partkey) AS part, any_value(l_suppkey) AS supp,
         any_value(l_orderkey) AS l_orderkey, any_value(m1) AS m1, any_value(m2) AS m2,
         any_value(price_field) AS price_field, any_value(l_linestatus) AS grau, any_value(filed) AS filed,
         any_value(payload_sha256) AS payload_sha256
  FROM sound GROUP BY representation_id, version_id),
elements AS (
  SELECT *, code1 AS code, 0 AS position FROM versions WHERE t IN (5, 6, 7, 8)
  UNION ALL
  SELECT *, code2 AS code, 1 AS position FROM versions WHERE t IN (6, 7, 8)),
movements AS (
  SELECT *,
    '{"camposExtras":{"extra":' || line || price_field || '},"codigo":' || code
      || ',"complementosTabelados":[{"a":1},{"b":2}],"dataHora":"2020-01-0' || line
      || 'T10:00:00Z","dataHoraNormalizada":"2020-01-0' || line
      || 'T10:00:00.000000Z","dataHoraStatus":"timezone_aware","nome":"' || flag || '"}' AS content,
    sha256(content) AS content_sha256,
    '{"codigo":' || code || ',"complementosTabelados":{"present":true,"value":[{"a":1},{"b":2}]},"dataHora":"2020-01-0'
      || line || 'T10:00:00.000000Z","orgaoJulgador":{"present":false}}' AS auxiliary_key
  FROM elements),
contents AS (
  SELECT representation_id, version_id, content_sha256, first_at, any_value(auxiliary_key) AS auxiliary_key,
         any_value(code) AS code, count(*) AS copies
  FROM movements GROUP BY representation_id, version_id, content_sha256, first_at)
"""
