"""The CSV export of selected processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.functions import dates as D
from docketflow.functions import text as X
from docketflow.operators.filters import CaseTables, ProcessFilters, select_processes, with_triage

# The columns of the export, in order.
HEADERS = (
    "numero_cnj", "tribunal", "classes", "graus", "orgaos", "assuntos", "triagem", "vinculo_rural",
    "motivos_captura", "acompanhado", "primeira_observacao", "ultima_observacao", "data_source", "exportado_em",
)

_BYTE_ORDER_MARK = "\ufeff"


class ExportTooLarge(ValueError):
    """More processes match than one export may hold. Nothing is written."""


def _joined(values: Column) -> Column:
    return F.array_join(F.array_sort(values), "; ")


def export_rows(
    tables: CaseTables, observations: DataFrame, filters: ProcessFilters, exported_at: str,
    environment: str = "demo",
) -> DataFrame:
    """One row per selected process with its distinct, sorted values.

    Values are made distinct per process before they are listed, so a list is as long as the
    process has different values, not as long as it has rows.
    """
    filters = filters.resolved()
    chosen = select_processes(tables, filters, environment).select("process_id", "process_number")
    owned = tables.representations
    if filters.tribunals is not None:
        owned = owned.where(F.col("tribunal").isin(*filters.tribunals))
    owned = owned.join(chosen, "process_id", "left_semi")
    homes = owned.select("representation_id", "process_id")
    flat = owned.select(
        "process_id", "tribunal", "grau",
        X.labeled(F.col("class_name"), F.col("class_code")).alias("class_label"),
        X.labeled(F.col("court_unit_name"), F.col("court_unit_code")).alias("court_label"),
        "created_at", "last_observed_at",
    )
    lists = flat.groupBy("process_id").agg(
        _joined(F.collect_set(F.nullif("tribunal", F.lit("")))).alias("tribunal"),
        _joined(F.collect_set("class_label")).alias("classes"),
        _joined(F.collect_set(F.nullif("grau", F.lit("")))).alias("graus"),
        _joined(F.collect_set("court_label")).alias("orgaos"),
        F.min("created_at").alias("first_created"),
        F.max("last_observed_at").alias("last_observed"),
    )
    subject_lists = (
        tables.subjects.join(homes, "representation_id")
        .select("process_id", X.labeled(F.col("subject_name"), F.col("subject_code")).alias("label"))
        .groupBy("process_id")
        .agg(_joined(F.collect_set("label")).alias("assuntos"))
    )
    first_seen = (
        observations.select("representation_id", "observed_at")
        .join(homes, "representation_id")
        .groupBy("process_id")
        .agg(F.min("observed_at").alias("first_observed"))
    )
    reason = F.get_json_object("criteria", "$.query.catalog_snapshot.capture_explanation")
    explained = tables.collections.select("collection_id", reason.alias("reason")).where(
        F.trim(F.col("reason")) != ""
    )
    reasons = (
        tables.results.select("collection_id", "representation_id")
        .join(homes, "representation_id")
        .select("collection_id", "process_id")
        .distinct()
        .join(explained, "collection_id")
        .groupBy("process_id")
        .agg(_joined(F.collect_set("reason")).alias("motivos_captura"))
    )
    followed = tables.watchlist.where("active").select("process_id", F.lit(True).alias("followed")).distinct()
    wide = with_triage(chosen, tables.triage)
    for part in (lists, subject_lists, first_seen, reasons, followed):
        wide = wide.join(part, "process_id", "left")

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    def moment(column: Column) -> Column:
        return F.coalesce(D.iso_z(column), F.lit(""))

    cells = {
        "tribunal": text("tribunal"),
        "classes": text("classes"),
        "graus": text("graus"),
        "orgaos": text("orgaos"),
        "assuntos": text("assuntos"),
        "triagem": X.mapped(F.col("decision"), X.DECISION_LABELS),
        "vinculo_rural": X.mapped(F.col("rural_link"), X.LINK_LABELS),
        "motivos_captura": text("motivos_captura"),
        "acompanhado": F.when(F.col("followed"), "Sim").otherwise("Não"),
        "primeira_observacao": moment(F.coalesce("first_observed", "first_created")),
        "ultima_observacao": moment(F.col("last_observed")),
        "data_source": F.lit(environment),
        "exportado_em": F.lit(exported_at),
    }
    return wide.select(
        F.col("process_number").alias("numero_cnj"),
        *[X.neutralized(cells[name]).alias(name) for name in HEADERS[1:]],
        "process_id",
    )


def write_csv(rows: DataFrame, path: str, limit: int, chosen: DataFrame | None = None) -> int:
    """Write the export as CSV part files, each with the header, ordered by case number.

    Counts first and refuses a too large export instead of cutting it. ``chosen`` has one row for each exported
    process; counting it spares the plan of the cells. Returns the row count.
    """
    count = (rows if chosen is None else chosen).count()
    if count > limit:
        raise ExportTooLarge(f"{count} processes match and one export holds {limit}")
    ordered = rows.orderBy("numero_cnj", "process_id").select(*HEADERS)
    # The writer has no byte order mark of its own: it goes before the first header cell.
    marked = ordered.withColumnRenamed(HEADERS[0], _BYTE_ORDER_MARK + HEADERS[0])
    (
        marked.write.mode("overwrite")
        .option("header", True)
        .option("sep", ";")
        .option("lineSep", "\r\n")
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return count
