"""Every process filter over the case tables, and the discovery query."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import functions as F

from docketflow.operators.filters import CaseTables, DiscoveryQuery, ProcessFilters, current_signals, discover, select_processes
from docketflow.plans import standins
from docketflow.plans.registry import query
from docketflow.plans.sqlparts import CASES, TRIBUNAL_LIST


def _chosen(spark, sf_dir, **filters):
    return select_processes(standins.case_tables(spark, sf_dir), ProcessFilters(**filters)).select("process_id")


def _rep(condition: str) -> str:
    return f"""WITH {CASES} SELECT process_id FROM processes p WHERE EXISTS (
  SELECT 1 FROM representations r WHERE r.process_id = p.process_id AND {condition})"""


@query("filter_case_number", f"WITH {CASES} SELECT process_id FROM processes WHERE process_number = '00000000000000000123'")
def filter_case_number(spark, sf_dir):
    """One process by its punctuated number."""
    return _chosen(spark, sf_dir, process_number="0000000-00.0000.0.00.0123")


@query("filter_decision_default", f"""WITH {CASES} SELECT process_id FROM processes p
WHERE EXISTS (SELECT 1 FROM triage t WHERE t.process_id = p.process_id AND t.decision = 'pending')
   OR NOT EXISTS (SELECT 1 FROM triage t WHERE t.process_id = p.process_id)""")
def filter_decision_default(spark, sf_dir):
    """Pending processes, those without a decision row among them."""
    return _chosen(spark, sf_dir, decision="pending")


@query("filter_decision", f"WITH {CASES} SELECT process_id FROM triage WHERE decision = 'discarded'")
def filter_decision(spark, sf_dir):
    """Discarded processes."""
    return _chosen(spark, sf_dir, decision="discarded")


@query("filter_link_default", f"""WITH {CASES} SELECT process_id FROM processes p
WHERE NOT EXISTS (SELECT 1 FROM triage t WHERE t.process_id = p.process_id AND t.rural_link <> 'unconfirmed')""")
def filter_link_default(spark, sf_dir):
    """Processes whose rural link is unconfirmed, explicitly or by default."""
    return _chosen(spark, sf_dir, rural_link="unconfirmed")


@query("filter_tribunals", _rep("r.tribunal IN ('TJGO', 'TJSP', 'TJMG')"))
def filter_tribunals(spark, sf_dir):
    """Processes with a representation in one of the tribunals."""
    return _chosen(spark, sf_dir, tribunals=("tjgo", " TJSP", "TJMG"))


@query("filter_subject_text", _rep("""EXISTS (SELECT 1 FROM subjects s WHERE s.representation_id = r.representation_id
  AND (contains(lower(s.subject_name), 'brand#2') OR contains(lower(s.subject_code), 'brand#2')))"""))
def filter_subject_text(spark, sf_dir):
    """Subjects by part of their name or code."""
    return _chosen(spark, sf_dir, subject=" BRAND#2 ")


@query("filter_subject_exact", _rep("""EXISTS (SELECT 1 FROM subjects s WHERE s.representation_id = r.representation_id
  AND s.subject_code = 'Brand#13' AND s.subject_name = 'ECONOMY')"""))
def filter_subject_exact(spark, sf_dir):
    """Code and name on one and the same subject row."""
    return _chosen(spark, sf_dir, subject_code="Brand#13", subject_name_exact="ECONOMY")


@query("filter_class", _rep("(contains(lower(r.class_name), 'classe r') OR contains(lower(r.class_code), 'classe r'))"))
def filter_class(spark, sf_dir):
    """Classes by part of their name or code."""
    return _chosen(spark, sf_dir, class_filter="CLASSE R")


@query("filter_court_unit", _rep("(contains(lower(r.court_unit_name), '07') OR contains(lower(r.court_unit_code), '07'))"))
def filter_court_unit(spark, sf_dir):
    """Court units by part of their name or code."""
    return _chosen(spark, sf_dir, court_unit="07")


@query("filter_literal_wildcards", _rep("r.court_unit_code::INT % 3 = 0 AND contains(lower(r.court_unit_name), 'r#00')"))
def filter_literal_wildcards(spark, sf_dir):
    """Percent sign and underscore stand for themselves: only names that hold both signs match."""
    tables = standins.case_tables(spark, sf_dir)
    marked = F.when(F.col("court_unit_code").cast("int") % 3 == 0, F.concat(F.lit("50%_"), "court_unit_name")).otherwise(
        F.translate("court_unit_name", "#", "%")
    )
    kept = {f.name: getattr(tables, f.name) for f in fields(CaseTables)}
    named = CaseTables(**{**kept, "representations": tables.representations.withColumn("court_unit_name", marked)})
    return select_processes(named, ProcessFilters(court_unit="0%_suppli")).select("process_id")


@query("filter_same_representation", _rep("""r.tribunal = 'TJGO' AND r.class_name = 'Classe A'
  AND EXISTS (SELECT 1 FROM subjects s WHERE s.representation_id = r.representation_id AND s.subject_name = 'PROMO')"""))
def filter_same_representation(spark, sf_dir):
    """Tribunal, class and subject must hold for the same representation."""
    return _chosen(spark, sf_dir, tribunals=("TJGO",), class_filter="classe a", subject_name_exact="PROMO")


@query("filter_collection_preset", _rep("""EXISTS (SELECT 1 FROM results x JOIN runs USING (collection_id)
  WHERE x.representation_id = r.representation_id AND x.collection_id = '1997-05' AND preset_id = 'tema.primeiro')"""))
def filter_collection_preset(spark, sf_dir):
    """Seen in one collection and under one preset."""
    return _chosen(spark, sf_dir, collection_id="1997-05", preset_id="tema.primeiro")


@query("filter_followed", f"""WITH {CASES} SELECT process_id FROM processes
WHERE process_id IN (SELECT process_id FROM watchlist WHERE active)
  AND process_id NOT IN (SELECT process_id FROM news WHERE status = 'pending')""")
def filter_followed(spark, sf_dir):
    """Followed processes without pending news."""
    return _chosen(spark, sf_dir, followed=True, pending_news=False)


@query("filter_not_followed", f"""WITH {CASES} SELECT process_id FROM processes
WHERE process_id NOT IN (SELECT process_id FROM watchlist WHERE active)
  AND process_id IN (SELECT process_id FROM news WHERE status = 'pending')""")
def filter_not_followed(spark, sf_dir):
    """Processes with pending news that nobody follows."""
    return _chosen(spark, sf_dir, followed=False, pending_news=True)


@query("filter_signal_category", f"""WITH {CASES} SELECT process_id FROM processes
WHERE process_id IN (SELECT process_id FROM live_signals WHERE category = 'penhora')""")
def filter_signal_category(spark, sf_dir):
    """Processes with a current signal of a category whose rule is enabled at that version."""
    return _chosen(spark, sf_dir, signal_category="penhora")


@query("filter_signal_inactive", f"""WITH {CASES} SELECT process_id FROM processes
WHERE process_id IN (SELECT process_id FROM signals WHERE is_published AND is_current AND category = 'leilao' AND rule_id = 'sinal.leilao' AND rule_version = '1.0.0')""")
def filter_signal_inactive(spark, sf_dir):
    """Two categories where only one of the rules is enabled: signals of the other don't count."""
    tables = standins.case_tables(spark, sf_dir)
    rules = tables.rules.withColumn("enabled_real", F.col("rule_id") == "sinal.leilao")
    live = standins.signals(spark, sf_dir).withColumn("environment", F.lit("real"))
    kept = current_signals(live, rules, "real").where(F.col("category").isin("leilao", "penhora"))
    return tables.processes.join(kept, "process_id", "left_semi").select("process_id")


def _records(spark, sf_dir):
    line = standins.read(spark, sf_dir, "lineitem")
    nations = standins.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), standins.tribunal_of(F.col("s_nationkey")).alias("tribunal")
    )
    # Line items without a discount have an unknown second subject.
    second = F.when(F.col("l_discount") > 0.005, F.col("l_linenumber") + 10)
    return line.join(nations, "l_suppkey").select(
        standins.row_key().alias("record_id"), "tribunal",
        F.lpad(F.col("l_orderkey").cast("string"), 20, "0").alias("process_number"),
        F.to_date("l_shipdate").alias("filed_on"), F.col("l_quantity").cast("int").alias("class_code"),
        F.col("l_suppkey").alias("court_unit_code"),
        F.array(F.col("l_linenumber"), second).alias("subject_codes"),
        F.array(F.col("l_linenumber")).alias("movement_codes"),
    )


_RECORDS = f"""WITH records AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS record_id,
  {TRIBUNAL_LIST}[s_nationkey + 1] AS tribunal, l_shipdate AS filed, l_quantity::INT AS class_code, l_linenumber AS s1,
  CASE WHEN l_discount > 0.005 THEN l_linenumber + 10 END AS s2, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT record_id FROM records WHERE """


@query("discovery_and", _RECORDS + """tribunal = 'TJMA' AND filed >= '1996-01-01' AND filed < '1999-01-01'
  AND class_code IN (5, 6, 7, 8, 9, 10, 11, 12) AND (s1 IN (3, 14) OR coalesce(s2 IN (3, 14), false))""")
def discovery_and(spark, sf_dir):
    """A filing range, class codes and subject codes, all of them."""
    wanted = DiscoveryQuery(
        "tjma", "1996-01-01", "1999-01-01", class_codes=(5, 6, 7, 8, 9, 10, 11, 12, 5), subject_codes=(14, 3)
    )
    return discover(_records(spark, sf_dir), wanted).select("record_id")


@query("discovery_or", _RECORDS + """tribunal = 'TJMA' AND (class_code IN (5, 6) OR s1 IN (3, 14) OR coalesce(s2 IN (3, 14), false))
  AND s1 IN (1, 2, 3, 4)""")
def discovery_or(spark, sf_dir):
    """Class or subject codes, and movement codes."""
    wanted = DiscoveryQuery(
        "TJMA", class_codes=(5, 6), subject_codes=(14, 3), movement_codes=(1, 2, 3, 4), combine="OR"
    )
    return discover(_records(spark, sf_dir), wanted).select("record_id")


@query("discovery_court_unit", _RECORDS + "tribunal = 'TJMS' AND l_suppkey = 4")
def discovery_court_unit(spark, sf_dir):
    """One court unit of one tribunal."""
    return discover(_records(spark, sf_dir), DiscoveryQuery("TJMS", court_unit_code=4)).select("record_id")
