"""Case tables, hits and pages derived from the given TPC-H-like tables.

Orders play the processes, (order, supplier) pairs the representations, parts the subjects, line
items the news, signals and raw hits, events the pages and logs. All rows of the tables take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.operators.filters import CaseTables
from docketflow.sources.reference import TRIBUNALS, rules_frame


# Schemas of the given tables, so that no job is spent on reading footers first.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows, dealt by key unless the read has several splits for each core already."""
    splits = rows.rdd.getNumPartitions()
    return rows if splits >= 3 * rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(key)


def tribunal_of(nation: Column) -> Column:
    """One tribunal per nation key."""
    return F.element_at(F.array(*[F.lit(name) for name in TRIBUNALS]), nation + 1)


def representation_key(order: str = "l_orderkey", supplier: str = "l_suppkey") -> Column:
    return F.concat_ws("-", F.col(order).cast("string"), F.col(supplier).cast("string"))


def row_key() -> Column:
    """A text that orders line items the same way everywhere."""
    return F.concat_ws(
        "-", *[F.col(name).cast("string") for name in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    )


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("process_id"),
        F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("process_number"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_returnflag").alias("class_code"), F.max("l_linestatus").alias("grau"),
        F.min("l_shipdate").cast("timestamp").alias("created_at"),
        F.max("l_shipdate").cast("timestamp").alias("last_observed_at"),
    )
    suppliers = read(spark, sf_dir, "supplier")
    return pairs.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("process_id"),
        representation_key().alias("representation_id"),
        F.lit("synthetic").alias("source"),
        tribunal_of(F.col("s_nationkey")).alias("tribunal"),
        F.col("l_suppkey").cast("string").alias("source_id"),
        "class_code",
        F.concat(F.lit("Classe "), F.col("class_code")).alias("class_name"),
        "grau",
        F.col("s_suppkey").cast("string").alias("court_unit_code"),
        F.col("s_name").alias("court_unit_name"),
        "created_at", "last_observed_at",
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("subject_code"), F.col("p_type").alias("subject_name")
    )
    return (
        read(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_suppkey", F.col("l_partkey").alias("p_partkey"))
        .join(parts, "p_partkey")
        .select(representation_key().alias("representation_id"), "subject_code", "subject_name")
    )


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of low or unknown priority were never judged."""
    return (
        read(spark, sf_dir, "orders")
        .where(~F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"))
        .select(
            F.col("o_orderkey").alias("process_id"),
            F.when(F.col("o_orderstatus") == "F", "discarded")
            .when(F.col("o_orderstatus") == "O", "relevant")
            .otherwise("pending")
            .alias("decision"),
            F.when(F.col("o_totalprice") > 200000, "confirmed").otherwise("unconfirmed").alias("rural_link"),
        )
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "orders")
        .where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .select(
            F.col("o_orderkey").alias("process_id"), (F.col("o_orderpriority") == "1-URGENT").alias("active"),
            F.col("o_orderdate").cast("timestamp").alias("included_at"),
        )
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "lineitem")
        .where(F.col("l_returnflag") != "N")
        .select(
            row_key().alias("news_id"),
            F.col("l_orderkey").alias("process_id"),
            representation_key().alias("representation_id"),
            F.when(F.col("l_linestatus") == "O", "NEW_OBSERVATION").otherwise("ALTERATION_OBSERVED").alias("category"),
            F.when(F.col("l_returnflag") == "R", "pending").otherwise("seen").alias("status"),
            F.col("l_shipdate").cast("timestamp").alias("first_observed_at"),
        )
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return read(spark, sf_dir, "lineitem").select(
        row_key().alias("signal_id"),
        F.col("l_orderkey").alias("process_id"),
        representation_key().alias("representation_id"),
        F.when(flag == "A", "sinal.leilao").otherwise("sinal.penhora").alias("rule_id"),
        F.when(flag == "N", "0.9.0").otherwise("1.0.0").alias("rule_version"),
        F.lit("demo").alias("environment"),
        F.when(flag == "A", "leilao").otherwise("penhora").alias("category"),
        (F.col("l_tax") > 0.015).alias("is_published"),
        (F.col("l_linestatus") == "O").alias("is_current"),
        (F.col("l_discount") > 0.055).alias("evidence_stale"),
        F.col("l_shipdate").cast("timestamp").alias("evaluated_at"),
    )


def month_of(column: str) -> Column:
    return F.date_format(column, "yyyy-MM")


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months in which an order is placed or a representation is first shipped."""
    shipped = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_shipdate").alias("day"))
    days = read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("day")).unionByName(shipped.select("day"))
    months = days.groupBy(month_of("day").alias("collection_id")).agg(F.min("day").cast("timestamp").alias("created_at"))
    number = F.substring("collection_id", 6, 2)
    # The last month of a year has no stored theme name.
    theme = F.when(
        number != "12",
        F.concat(F.lit('"catalog_snapshot":{"name":"Créditos '), number,
                 F.lit('","capture_explanation":"Assunto do mês '), number, F.lit('"}')),
    ).otherwise(F.lit('"catalog_snapshot":{}'))
    return months.select(
        "collection_id", "created_at", F.lit("demo").alias("mode"),
        F.concat(F.lit('{"query":{'), theme, F.lit("}}")).alias("criteria"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("collection_id", 6, 2).cast("int")
    return collections(spark, sf_dir).select(
        F.concat(F.lit("run-"), F.col("collection_id")).alias("run_id"),
        "collection_id", "mode", "created_at",
        F.when(number <= 3, "completed").when(number <= 6, "partial").when(number <= 9, "failed")
        .otherwise("queued").alias("status"),
        F.when(number % 2 == 0, "collect_preset").otherwise("refresh_number").alias("kind"),
        tribunal_of(number).alias("tribunal"),
        F.concat(
            F.lit('{"query":{"preset_id":"'),
            F.when(number <= 6, "tema.primeiro").when(number <= 11, "custom:segundo").otherwise("antigo"),
            F.lit('"}}'),
        ).alias("parameters"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A representation is included by the month of its order, and again by the month it ships."""
    pairs = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_shipdate").alias("shipped")
    )
    dated = pairs.join(
        read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey"
    )
    key = representation_key().alias("representation_id")
    ordered = dated.select(
        key, month_of("o_orderdate").alias("collection_id"), F.col("o_orderdate").cast("timestamp").alias("included_at"),
        F.lit("new").alias("capture_outcome"),
    )
    shipped = dated.where(month_of("o_orderdate") != month_of("shipped")).select(
        key, month_of("shipped").alias("collection_id"), F.col("shipped").cast("timestamp").alias("included_at"),
        F.lit("updated").alias("capture_outcome"),
    )
    return ordered.unionByName(shipped)


class StandInTables(CaseTables):
    """The case tables, each one built when a read first asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        object.__setattr__(self, "_place", (spark, sf_dir))

    def __getattribute__(self, name: str):
        makers = _MAKERS
        if name not in makers:
            return object.__getattribute__(self, name)
        built = object.__getattribute__(self, "__dict__")
        if name not in built:
            built[name] = makers[name](*built["_place"])
        return built[name]


_MAKERS = {
    "processes": processes,
    "representations": representations,
    "subjects": subjects,
    "triage": triage,
    "watchlist": watchlist,
    "news": news,
    "signals": signals,
    "results": results,
    "collections": collections,
    "runs": runs,
    "rules": lambda spark, sf_dir: rules_frame(spark),
}


def case_tables(spark: SparkSession, sf_dir: str) -> CaseTables:
    return StandInTables(spark, sf_dir)


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit text per line item, sound or with one of the defects a source shows.

    A representation is (order, line number), so repeated pairs become its versions. Which defect
    a hit has follows from its tax, discount and quantity.
    """
    # Each row becomes a text to parse, so a table of a few splits is dealt by key first.
    line = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey").withColumns(
        {
            "t": F.round(F.col("l_tax") * 100).cast("int"),
            "d": F.round(F.col("l_discount") * 100).cast("int"),
            "q": F.col("l_quantity").cast("int"),
            "id": F.concat(F.lit("r"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")),
        }
    )
    code = F.floor(F.col("q") / 10).cast("int")
    price = F.format_string("%.2f", F.col("l_extendedprice"))

    def movement(number: Column, swapped: bool) -> Column:
        date = F.concat(F.lit('"dataHora":"2020-01-0'), F.col("l_linenumber"), F.lit('T10:00:00Z"'))
        name = F.concat(F.lit('"nome":"'), F.col("l_returnflag"), F.lit('"'))
        number_field = F.concat(F.lit('"codigo":'), number)
        extra = F.concat(F.lit('"extra":'), F.col("l_linenumber"))
        value = F.when(F.col("t") == 8, F.concat(F.lit(',"valor": '), price)).otherwise("")
        if swapped:
            parts = [number_field, F.lit('"complementosTabelados":[{"a":1},{"b":2}]'), extra, name, date]
        else:
            parts = [name, number_field, date, F.lit('"complementosTabelados":[{"b":2}, {"a":1}]'), extra]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), value, F.lit("}"))

    first = movement(code, False)
    second = F.when(F.col("d") % 2 == 0, movement(code, True)).otherwise(movement(code + 1, True))
    array = (
        F.when(F.col("t") == 1, F.lit(""))
        .when(F.col("t") == 2, F.lit('"movimentos":null,'))
        .when(F.col("t") == 3, F.lit('"movimentos":"nada",'))
        .when(F.col("t") == 4, F.lit('"movimentos":[],'))
        .when(F.col("t") == 5, F.concat(F.lit('"movimentos":['), first, F.lit(", 7],")))
        .otherwise(F.concat(F.lit('"movimentos":['), first, F.lit(","), second, F.lit("],")))
    )
    own_id = (
        F.when(F.col("t") == 0, F.lit(""))
        .when(F.col("d") == 10, F.concat(F.lit('"id":"other-'), F.col("id"), F.lit('",')))
        .otherwise(F.concat(F.lit('"id":"'), F.col("id"), F.lit('",')))
    )
    number = F.when(F.col("q") == 50, F.lit("123")).otherwise(F.lpad(F.col("l_orderkey").cast("string"), 20, "0"))
    filed = F.when(
        F.col("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy-MM-dd'T00:00:00-03:00'")
    ).otherwise(F.date_format("l_shipdate", "yyyyMMdd'000000'"))
    source = F.concat(
        F.lit("{"), own_id, array,
        F.lit('"tribunal":"'), F.when(F.col("q") == 49, "TJSP").otherwise("TJGO"),
        F.lit('","numeroProcesso":"'), number,
        F.lit('","grau":"'), F.col("l_linestatus"),
        F.lit('","dataAjuizamento":"'), filed,
        F.lit('","@timestamp":"'), F.date_format("l_shipdate", "yyyy-MM-dd'T00:00:00Z'"),
        F.lit('","classe":{"nome":" Flag '), F.col("l_returnflag"), F.lit(' ","codigo":'), F.col("l_suppkey"),
        F.lit('},"orgaoJulgador":{"nome":"","codigo":"'), F.col("l_partkey"),
        F.lit('"},"assuntos":[{"nome":"Part '), F.col("l_partkey"), F.lit('","codigo":'), F.col("l_partkey"),
        F.lit('},{"codigo":null},{"nome":"'), F.col("l_returnflag"), F.lit('"}]}'),
    )
    hit_id = F.when(F.col("q") == 48, F.lit("7")).otherwise(F.concat(F.lit('"'), F.col("id"), F.lit('"')))
    millis = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    hit = F.concat(
        F.lit('{"sort":['), millis, F.lit(',"'), F.col("id"), F.lit('"], "_id":'), hit_id, F.lit(',"_source":'),
        source, F.lit("}"),
    )
    from docketflow.sources.pages import page_key

    collection = F.concat(F.lit("c"), F.col("l_orderkey"))
    return line.select(
        collection.alias("collection_id"),
        F.col("l_partkey").alias("page_revision"),
        page_key(collection, F.col("l_partkey")).alias("page_key"),
        F.col("l_linenumber").alias("hit_ordinal"),
        F.col("l_shipdate").cast("timestamp").alias("responded_at"),
        F.lit("TJGO").alias("tribunal"),
        F.lit("demo").alias("mode"),
        hit.alias("hit"),
    )


#: Hits per page of the event pages.
EVENT_PAGE = 100


def event_source(number: Column | None = None) -> Column:
    """The record of an event. Users play the representations, so a page repeats some of them."""
    number = F.lpad(F.col("user_id").cast("string"), 20, "0") if number is None else number
    return F.concat(
        F.lit('{"numeroProcesso":"'), number, F.lit('","id":"u'), F.col("user_id"), F.lit('","tribunal":"TJGO","tipo":"'), F.col("event_type"),
        F.lit('","movimentos":[{"codigo":'), F.get_json_object("props", "$.k"), F.lit("}]}"),
    )


def event_hit(sort: Column, source: Column) -> Column:
    return F.concat(F.lit('{"_id":"u'), F.col("user_id"), F.lit('","sort":['), sort, F.lit('],"_source":'), source, F.lit("}"))


def event_pages(spark: SparkSession, sf_dir: str, sort: Column | None = None, source: Column | None = None) -> DataFrame:
    """Page envelopes of at most 100 hits, cut along the unique event ids. ``sort`` and ``source`` replace parts of every hit."""
    events = read(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    sort = F.concat(micros, F.lit(',"e'), F.col("event_id"), F.lit('"')) if sort is None else sort
    hit = event_hit(sort, event_source() if source is None else source)
    page = F.floor(F.col("event_id") / EVENT_PAGE)
    grouped = events.select(page.alias("page_revision"), "event_id", "ts", hit.alias("hit")).groupBy("page_revision").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "hit"))).alias("hits"),
        F.max("ts").cast("timestamp").alias("responded_at"),
    )
    # Totals come as a number, as a lower bound, or not at all.
    revision = F.col("page_revision")
    total = (
        F.when(revision % 3 == 0, F.lit('"total":{"value":10000,"relation":"gte"},'))
        .when(revision % 3 == 1, F.concat(F.lit('"total":'), revision + 500, F.lit(",")))
        .otherwise("")
    )
    payload = F.concat(
        F.lit('{"took":1,"hits":{'), total, F.lit('"hits":['), F.array_join(F.col("hits.hit"), ","), F.lit("]}}")
    )
    return grouped.select(
        F.lit("events").alias("collection_id"), "page_revision", "responded_at", F.lit("TJGO").alias("tribunal"),
        F.lit("demo").alias("mode"), payload.alias("payload"),
    )
