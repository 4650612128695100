"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketflow.functions import codes as C
from docketflow.functions import dates as D
from docketflow.functions import jsonvalue as J
from docketflow.functions import text as X
from docketflow.plans import standins
from docketflow.plans.registry import query
from docketflow.sources.reference import canonical_tribunal


@query("case_numbers", """WITH n AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 20, '0') AS d, o_orderstatus AS s FROM orders),
f AS (SELECT *, substr(d, 1, 7) || '-' || substr(d, 8, 2) || '.' || substr(d, 10, 4) || '.' || substr(d, 14, 1) || '.' || substr(d, 15, 2) || '.' || substr(d, 17, 4) AS dotted FROM n)
SELECT o_orderkey, CASE WHEN s = 'P' THEN NULL ELSE d END AS digits, CASE WHEN s = 'P' THEN '1.' || d ELSE dotted END AS shown FROM f""")
def case_numbers(spark, sf_dir):
    """Plain, punctuated and broken case numbers through both directions."""
    digits = F.lpad(F.col("o_orderkey").cast("string"), 20, "0")
    status = F.col("o_orderstatus")
    written = F.when(status == "F", X.formatted_case_number(digits)).when(status == "P", F.concat(F.lit("1."), digits)).otherwise(digits)
    orders = standins.read(spark, sf_dir, "orders").select("o_orderkey", written.alias("w"))
    return orders.select("o_orderkey", X.case_number(F.col("w")).alias("digits"), X.formatted_case_number(F.col("w")).alias("shown"))


@query("canonical_hash", """SELECT event_id, sha256('{"a":[' || (value = floor(value))::VARCHAR || ',null,"é"],"k":' || json_extract(props, '$.k')
  || ',"t":"' || event_type || '","v":' || value::VARCHAR || '}') AS h FROM events""")
def canonical_hash(spark, sf_dir):
    """Hashes of canonical JSON with shuffled keys, blanks and fractions."""
    whole = F.when(F.col("value") == F.floor("value"), "true").otherwise("false")
    text = F.concat(
        F.lit('{ "v": '), F.format_string("%.2f", "value"), F.lit(', "t":"'), F.col("event_type"), F.lit('",\n"k" : '), F.get_json_object("props", "$.k"),
        F.lit(', "a":[ '), whole, F.lit(',null , "\\u00e9"]}'),
    )
    return standins.read(spark, sf_dir, "events").select("event_id", J.content_hash(J.canonical_json(text)).alias("h"))


@query("canonical_props", """SELECT event_id, sha256('{"k":' || json_extract(props, '$.k') || '}') AS h FROM events""")
def canonical_props(spark, sf_dir):
    """Hashes of the events' own JSON in canonical form."""
    return standins.read(spark, sf_dir, "events").select("event_id", J.content_hash(J.canonical_json(F.col("props"))).alias("h"))


@query("date_status", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS d, l_linenumber AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE n WHEN 1 THEN 'timezone_aware' WHEN 2 THEN 'timezone_aware' WHEN 3 THEN 'timezone_ambiguous' WHEN 4 THEN 'timezone_ambiguous'
  WHEN 5 THEN 'unparseable' WHEN 6 THEN 'null' ELSE 'missing' END AS status,
  CASE n WHEN 1 THEN d || 'T10:30:00' WHEN 2 THEN d || 'T13:30:00' END AS instant, n IN (3, 4, 5) AS ambiguous FROM t""")
def date_status(spark, sf_dir):
    """Dates with zone, without zone, unreadable, null and missing."""
    day, number = F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_linenumber")
    value = (
        F.when(number == 1, F.concat(F.lit('"'), day, F.lit('T10:30:00Z"'))).when(number == 2, F.concat(F.lit('"'), day, F.lit('T10:30:00-03:00"')))
        .when(number == 3, F.concat(F.lit('"'), day, F.lit(' 10:30"'))).when(number == 4, F.concat(F.lit('"'), F.date_format("l_shipdate", "yyyyMMdd"), F.lit('103000"')))
        .when(number == 5, F.concat(F.lit('"'), day, F.lit('"'))).when(number == 6, F.lit("null"))
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    text = F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"d":'), value), F.lit("")), F.lit("}"))
    opened = standins.read(spark, sf_dir, "lineitem").select(*keys, J.get(F.try_parse_json(text), "$.d").alias("v"))
    schema, shown = C.leaf(F.col("v"))
    leaf = opened.select(*keys, schema.alias("schema"), F.when(schema == "STRING", shown).alias("text"))
    plain = leaf.select("*", D.readable(F.col("text"), date_only=False).alias("plain"), D.readable(F.col("text")).alias("loose"))
    strict, cover = D.parsed(F.col("plain")), D.parsed(F.col("loose"))
    return plain.select(
        *keys, D.status(F.col("schema"), strict.wall, strict.aware).alias("status"),
        F.date_format(strict.instant, "yyyy-MM-dd'T'HH:mm:ss").alias("instant"),
        (cover.wall.isNotNull() & ~cover.aware).alias("ambiguous"),
    )


@query("calendar_windows", """SELECT o_orderkey, strftime(o_orderdate - INTERVAL 12 MONTH, '%Y-%m-%d') AS year_before, strftime(o_orderdate - INTERVAL 1 MONTH, '%Y-%m-%d') AS month_before,
  strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS exclusive_end FROM orders""")
def calendar_windows(spark, sf_dir):
    """Rolling and inclusive filing windows."""
    day = F.to_date("o_orderdate")
    _, end = D.inclusive_window(day, day)
    start, _ = D.rolling_window(F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 12 HOURS"))
    return standins.read(spark, sf_dir, "orders").select(
        "o_orderkey", start.cast("string").alias("year_before"), D.months_before(day, 1).cast("string").alias("month_before"), end.cast("string").alias("exclusive_end")
    )


@query("daily_schedule", """SELECT event_id, strftime(CASE WHEN ts < date_trunc('day', ts) + INTERVAL 9 HOUR THEN date_trunc('day', ts) + INTERVAL 9 HOUR
  ELSE date_trunc('day', ts) + INTERVAL 33 HOUR END, '%Y-%m-%d %H:%M:%S') AS next_run, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') AS local_day,
  strftime(ts - INTERVAL 3 HOUR, '%d/%m/%Y %H:%M') AS shown FROM events""")
def daily_schedule(spark, sf_dir):
    """The next 06:00 in the schedule's zone, and local dates."""
    moment = F.col("ts").cast("timestamp")
    return standins.read(spark, sf_dir, "events").select(
        "event_id", F.date_format(D.next_daily_run(moment), "yyyy-MM-dd HH:mm:ss").alias("next_run"),
        D.local_date(moment).cast("string").alias("local_day"), D.local_minute_label(moment).alias("shown"),
    )


@query("structured_codes", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber WHEN 1 THEN l_partkey::VARCHAR WHEN 2 THEN '00' || l_partkey WHEN 5 THEN l_partkey || 'x' END AS cover_code,
  CASE WHEN l_partkey > 0 AND l_linenumber IN (1, 2) THEN l_partkey::VARCHAR END AS rule_code,
  CASE l_linenumber WHEN 6 THEN l_partkey::VARCHAR WHEN 7 THEN l_partkey || ',' || l_suppkey || repeat(',' || l_orderkey || ',' || l_suppkey, (l_suppkey % 2)::INT) ELSE '' END AS nested FROM lineitem""")
def structured_codes(spark, sf_dir):
    """Codes as integers, texts, fractions, booleans, objects and lists inside lists."""
    part, number = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    # Half of the lists hold another one thirty lists down, and one six lists down behind it.
    deep = F.when(F.col("l_suppkey") % 2 == 1, F.concat(
        F.lit("," + "[" * 30 + '{"codigo":'), F.col("l_orderkey"), F.lit("}" + "]" * 30 + "," + "[" * 6 + '{"codigo":'), F.col("l_suppkey"), F.lit("}" + "]" * 6)
    )).otherwise("")
    text = (
        F.when(number == 1, part).when(number == 2, F.concat(F.lit('" 00'.replace(" ", "")), part, F.lit('"')))
        .when(number == 3, F.lit("true")).when(number == 4, F.lit("31.5")).when(number == 5, F.concat(F.lit('" '), part, F.lit('x "')))
        .when(number == 6, F.concat(F.lit('{"codigo":'), part, F.lit("}")))
        .otherwise(F.concat(F.lit('[{"codigo":"'), part, F.lit('"},[{"codigo":'), F.col("l_suppkey"), F.lit('},{"nome":"x"}]'), deep, F.lit("]")))
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    value = standins.read(spark, sf_dir, "lineitem").select(*keys, F.try_parse_json(text).alias("v"))
    leaf = value.select("*", *[part.alias(name) for name, part in zip(("s", "t"), C.leaf(F.col("v")))])
    return leaf.select(
        *keys, C.cover_code(F.col("s"), F.col("t")).alias("cover_code"), C.rule_code(F.col("s"), F.col("t")).alias("rule_code"),
        F.array_join(C.nested_codes(F.col("v")), ",").alias("nested"),
    )


@query("redaction", """SELECT event_id, CASE event_type WHEN 'view' THEN '{"k":' || json_extract(props, '$.k') || ',"v":[1.0,"<numeroProcesso-observado-redigido>"]}'
  ELSE '{"k":' || json_extract(props, '$.k') || ',"n":["<numeroProcesso-observado-redigido>","x"],"q":[{"f":1.0,"search_after":["<cursor-redigido>","<cursor-redigido>","<cursor-redigido>"]}],"search_after":["<cursor-redigido>","<cursor-redigido>"]}' END AS shown FROM events""")
def redaction(spark, sf_dir):
    """Case numbers and cursors at any depth hidden in payloads; other values stay as written."""
    digits = F.lpad(F.col("user_id").cast("string"), 20, "0")
    text = F.concat(
        F.lit('{"search_after":[1,"'), digits, F.lit('"],"q":[{"search_after":[[1,2],{"a":3},4],"f":1.0}],"n":["'), digits, F.lit('","x"],"k":'), F.get_json_object("props", "$.k"), F.lit("}")
    )
    plain = F.concat(F.lit('{"v":[1.0,"'), digits, F.lit('"],"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    text = F.when(F.col("event_type") == "view", plain).otherwise(text)
    return standins.read(spark, sf_dir, "events").select("event_id", J.redact(text).alias("shown"))


@query("labels_and_neutral", """SELECT doc_id, CASE WHEN regexp_matches(p, '^[\\s]*[=+\\-@]') THEN '''' || p ELSE p END AS neutral,
  CASE WHEN lang = 'en' THEN source || ' (' || lang || ')' WHEN lang = 'de' THEN source ELSE lang END AS label, translate(lower(text), 'áàâãäåçéèêëíìîïñóòôõöúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS folded
FROM (SELECT *, CASE source WHEN 'src0' THEN '=' WHEN 'src1' THEN '  @' WHEN 'src2' THEN chr(9) || '+' ELSE '' END || text AS p FROM documents)""")
def labels_and_neutral(spark, sf_dir):
    """Spreadsheet-safe texts, labels and folding over whole documents."""
    source = F.col("source")
    prefix = F.when(source == "src0", "=").when(source == "src1", "  @").when(source == "src2", "\t+").otherwise("")
    lang = F.col("lang")
    return standins.read(spark, sf_dir, "documents").select(
        "doc_id", X.neutralized(F.concat(prefix, "text")).alias("neutral"),
        X.labeled(F.when(lang.isin("en", "de"), source), F.when(lang == "de", "").otherwise(lang)).alias("label"),
        X.folded(F.col("text")).alias("folded"),
    )


@query("tribunal_names", """SELECT c_custkey, CASE c_mktsegment WHEN 'FURNITURE' THEN 'TJGO' WHEN 'MACHINERY' THEN 'TRF1' END AS tribunal FROM customer""")
def tribunal_names(spark, sf_dir):
    """Aliases and names in any case against the list of tribunals."""
    segment = F.col("c_mktsegment")
    written = F.when(segment == "FURNITURE", " tjgo ").when(segment == "MACHINERY", "Trf1").otherwise(segment)
    return standins.read(spark, sf_dir, "customer").select("c_custkey", canonical_tribunal(written).alias("tribunal"))
