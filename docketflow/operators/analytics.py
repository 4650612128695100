"""Overview metrics, facets, summaries and paged lists.

Children are reduced to one row per process before they meet the process row. That keeps counts
free of fan-out without any distinct over joined rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.functions import codes as C
from docketflow.functions import dates as D
from docketflow.functions import jsonvalue as J
from docketflow.functions import text as X
from docketflow.operators.filters import (
    CaseTables, ProcessFilters, current_signals, select_processes, with_triage,
)
from docketflow.operators.ordered import latest

FACET_LIMIT = 10
FACET_LIMIT_WITH_TEXT = 20


def _in_tribunals(df: DataFrame, filters: ProcessFilters) -> DataFrame:
    return df if filters.tribunals is None else df.where(F.col("tribunal").isin(*filters.tribunals))


def overview_statistics(tables: CaseTables, filters: ProcessFilters, environment: str = "demo") -> DataFrame:
    """One row with the headline counts of the selected processes.

    A tribunal filter also limits which representations are counted, not only which processes
    are selected.
    """
    filters = filters.resolved()
    selected = select_processes(tables, filters, environment).select("process_id")
    per_process = (
        _in_tribunals(tables.representations, filters)
        .groupBy("process_id")
        .agg(F.count(F.lit(1)).alias("representations"), F.max("last_observed_at").alias("last_observed_at"))
    )
    followed = tables.watchlist.where("active").select("process_id", F.lit(1).alias("followed")).distinct()
    pending = tables.news.where("status = 'pending'").groupBy("process_id").agg(
        F.count(F.lit(1)).alias("pending_news")
    )
    wide = (
        with_triage(selected, tables.triage)
        .join(per_process, "process_id", "left")
        .join(followed, "process_id", "left")
        .join(pending, "process_id", "left")
    )
    decision = F.col("decision")

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("long")

    return wide.agg(
        F.count(F.lit(1)).alias("process_count"),
        total("representations").alias("representation_count"),
        F.count_if(decision == "pending").alias("triage_pending"),
        F.count_if(decision == "relevant").alias("triage_relevant"),
        F.count_if(decision == "discarded").alias("triage_discarded"),
        total("followed").alias("followed_process_count"),
        total("pending_news").alias("pending_news_count"),
        F.max("last_observed_at").alias("latest_observation_at"),
    )


def signal_distribution(tables: CaseTables, filters: ProcessFilters, environment: str = "demo") -> DataFrame:
    """Distinct selected processes per category of current signals."""
    live = current_signals(tables.signals, tables.rules, environment)
    selected = select_processes(tables, filters, environment)
    return (
        live.select("category", "process_id")
        .join(selected, "process_id", "left_semi")
        .groupBy("category")
        .agg(F.count_distinct("process_id").alias("process_count"))
        .orderBy("category")
    )


def theme_distribution(tables: CaseTables, filters: ProcessFilters, environment: str = "demo") -> DataFrame:
    """Distinct selected processes per subject. A process counts under each of its subjects."""
    filters = filters.resolved()
    kept = _in_tribunals(tables.representations, filters).join(
        select_processes(tables, filters, environment), "process_id", "left_semi"
    )
    return (
        tables.subjects.select("representation_id", "subject_code", "subject_name")
        .join(kept.select("representation_id", "process_id"), "representation_id")
        .groupBy("subject_code", "subject_name")
        .agg(F.count_distinct("process_id").alias("process_count"))
        .orderBy(F.desc("process_count"), F.asc_nulls_last("subject_code"), F.asc_nulls_last("subject_name"))
    )


def latest_collections(runs: DataFrame, filters: ProcessFilters = ProcessFilters(), count: int = 5) -> DataFrame:
    """The most recent collection runs."""
    return (
        _in_tribunals(runs.where(F.col("collection_id").isNotNull()), filters.resolved())
        .orderBy(F.desc("created_at"), F.desc("run_id"))
        .limit(count)
        .select("collection_id", "run_id", "mode", "status", "created_at")
    )


def facet_candidates(tables: CaseTables, field: str, environment: str = "demo") -> DataFrame:
    """(value, process_id) rows of a filter field."""

    def values(df: DataFrame, *columns: str) -> DataFrame:
        parts = [df.select(F.col(name).alias("value"), "process_id") for name in columns]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    if field == "process_number":
        return values(tables.processes, "process_number")
    if field in ("subject", "subject_code", "subject_name_exact"):
        owned = tables.subjects.select("representation_id", "subject_code", "subject_name").join(
            tables.representations.select("representation_id", "process_id"), "representation_id"
        )
        columns = {
            "subject": ("subject_name", "subject_code"),
            "subject_code": ("subject_code",),
            "subject_name_exact": ("subject_name",),
        }[field]
        return values(owned, *columns)
    if field == "class":
        return values(tables.representations, "class_name", "class_code")
    if field == "court_unit":
        return values(tables.representations, "court_unit_name", "court_unit_code")
    if field == "tribunal":
        return values(tables.representations, "tribunal")
    if field == "preset_id":
        presets = tables.runs.where(F.col("mode") == environment).select(
            "collection_id", F.get_json_object("parameters", "$.query.preset_id").alias("value")
        ).where(F.col("value").isNotNull())
        return (
            tables.results.select("collection_id", "representation_id")
            .join(presets, "collection_id")
            .join(tables.representations.select("representation_id", "process_id"), "representation_id")
            .select("value", "process_id")
        )
    if field == "signal_category":
        return values(current_signals(tables.signals, tables.rules, environment), "category")
    raise ValueError(f"unknown filter field: {field!r}")


def facet_options(
    tables: CaseTables, field: str, query: str = "", selected: str | None = None,
    environment: str = "demo", preset_names: dict[str, str] | None = None,
) -> DataFrame:
    """The most common values of a field, or those that match a text; a selected one comes first."""
    needle = X.fold_needle(query)
    if field == "process_number":
        needle = "".join(char for char in needle if char.isdigit())
    limit = FACET_LIMIT_WITH_TEXT if needle else FACET_LIMIT
    value = F.col("value")
    rows = facet_candidates(tables, field, environment).where(value.isNotNull() & (F.trim(value) != ""))
    if field == "process_number" and not needle and not selected:
        rows = rows.where(F.lit(False))
    matches: Column | None = None
    if needle:
        matches = F.contains(X.folded(value), F.lit(needle))
        if field == "preset_id":
            label = X.preset_label(value, preset_names or {})
            matches = matches | F.contains(X.folded(label), F.lit(needle))
    if selected:
        chosen = value == selected
        matches = chosen if matches is None else matches | chosen
    if matches is not None:
        rows = rows.where(matches)
    # A literal in an ordering would be read as a column position.
    pinned = [F.when(value == selected, 0).otherwise(1)] if selected else []
    label = value
    if field == "process_number":
        label = X.formatted_case_number(value)
    elif field == "preset_id":
        label = X.preset_label(value, preset_names or {})
    return (
        rows.groupBy("value")
        .agg(F.count_distinct("process_id").alias("process_count"))
        .orderBy(*pinned, F.desc("process_count"), F.asc("value"))
        .limit(limit)
        .select("value", label.alias("label"), "process_count")
    )


def collection_options(
    tables: CaseTables, query: str = "", selected: str | None = None, environment: str = "demo"
) -> DataFrame:
    """Collections to filter by, newest first, found by their theme, status or local time."""
    needle = X.fold_needle(query)
    limit = FACET_LIMIT_WITH_TEXT if needle else FACET_LIMIT
    theme = F.coalesce(
        F.get_json_object("criteria", "$.query.catalog_snapshot.name"), F.lit("Definição histórica")
    )
    counts = (
        tables.results.select("collection_id", "representation_id")
        .join(tables.representations.select("representation_id", "process_id"), "representation_id")
        .groupBy("collection_id")
        .agg(F.count_distinct("process_id").alias("process_count"))
    )
    states = tables.runs.select("collection_id", F.col("status").alias("run_status"))
    named = (
        tables.collections.where(F.col("mode") == environment)
        .select("collection_id", "created_at", theme.alias("theme_name"))
        .join(counts, "collection_id")
        .join(states, "collection_id", "left")
        .withColumns(
            {
                "status_label": X.mapped(F.col("run_status"), X.STATUS_LABELS, F.lit(X.NO_RUN_LABEL)),
                "local_time": D.local_minute_label(F.col("created_at")),
            }
        )
    )
    matches: Column | None = None
    if needle:
        matches = F.lit(False)
        for name in ("theme_name", "status_label", "local_time"):
            matches = matches | F.contains(X.folded(F.col(name)), F.lit(needle))
    if selected:
        chosen = F.col("collection_id") == selected
        matches = chosen if matches is None else matches | chosen
    if matches is not None:
        named = named.where(matches)
    pinned = [F.when(F.col("collection_id") == selected, 0).otherwise(1)] if selected else []
    return (
        named.orderBy(*pinned, F.desc("created_at"), F.desc("collection_id"))
        .limit(limit)
        .select(
            F.col("collection_id").alias("value"),
            F.concat_ws(" · ", "local_time", "theme_name", "status_label").alias("label"),
            X.process_count_label(F.col("process_count")).alias("detail"),
            "process_count",
        )
    )


def latest_results(results: DataFrame, collections: DataFrame, runs: DataFrame) -> DataFrame:
    """Each representation's most recent inclusion with its collection and run."""
    last = latest(
        results.select("representation_id", "collection_id", "included_at", "capture_outcome"),
        ["representation_id"], ["included_at", "collection_id"],
    )
    states = runs.select("collection_id", "run_id", F.col("status").alias("run_status"))
    return last.join(collections.select("collection_id", "mode"), "collection_id").join(
        states, "collection_id", "left"
    )


def process_summaries(tables: CaseTables, chosen: DataFrame, filters: ProcessFilters = ProcessFilters()) -> DataFrame:
    """Representation count, last observation, latest collection and decision per process."""
    owned = _in_tribunals(tables.representations, filters.resolved())
    per_process = owned.groupBy("process_id").agg(
        F.count(F.lit(1)).alias("representation_count"), F.max("last_observed_at").alias("latest_observed_at")
    )
    inclusion = latest_results(tables.results, tables.collections, tables.runs).join(
        owned.select("representation_id", "process_id"), "representation_id"
    )
    newest = latest(
        inclusion.select("process_id", "included_at", "collection_id", "representation_id", "capture_outcome",
                         "run_status"),
        ["process_id"], ["included_at", "representation_id"],
    ).select("process_id", F.col("collection_id").alias("latest_collection_id"), "included_at", "capture_outcome",
             "run_status")
    return (
        with_triage(chosen, tables.triage)
        .join(per_process, "process_id", "left")
        .join(newest, "process_id", "left")
        .withColumn("representation_count", F.coalesce("representation_count", F.lit(0)))
    )


def page_of(df: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """One page of an ordered list; ``order`` must end in a unique column."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("pages start at 1 and hold 1 to 100 rows")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """Row and page counts beside a page."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", X.page_count(F.col("total"), size))


def keyset_page(df: DataFrame, first: str, second: str, after: tuple | None, size: int) -> DataFrame:
    """The rows after a cursor on two columns; needs no offset and reads one page."""
    if after is not None:
        df = df.where(
            (F.col(first) > after[0]) | ((F.col(first) == after[0]) & (F.col(second) > after[1]))
        )
    return df.orderBy(first, second).limit(size)


def news_feed(
    news: DataFrame, status: str | None = None, category: str | None = None,
    process_id: object = None, chosen: DataFrame | None = None,
) -> DataFrame:
    """Change-feed entries under the given filters, newest first."""
    out = news
    for name, value in (("status", status), ("category", category), ("process_id", process_id)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if chosen is not None:
        out = out.join(chosen, "process_id", "left_semi")
    return out.orderBy(F.desc("first_observed_at"), F.desc("news_id"))


def run_list(runs: DataFrame, status: str | None = None, kind: str | None = None) -> DataFrame:
    out = runs
    for name, value in (("status", status), ("kind", kind)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.orderBy(F.desc("created_at"), F.desc("run_id"))


def observed_codes(versions: DataFrame) -> DataFrame:
    """Class and subject codes that a stored payload really carries."""
    opened = versions.select("version_id", F.try_parse_json("payload").alias("__v"))
    single = opened.select(
        "version_id", F.lit("class").alias("dimension"), J.get(F.col("__v"), "$.classe.codigo").alias("__code")
    )
    listed = opened.select(
        "version_id", F.lit("subject").alias("dimension"),
        F.explode(J.get(F.col("__v"), "$.assuntos", "array<variant>")).alias("item"),
    ).select("version_id", "dimension", J.get(F.col("item"), "$.codigo").alias("__code"))
    both = single.unionByName(listed)
    codes = both.select("version_id", "dimension", C.rule_code(*C.leaf(F.col("__code"))).alias("code"))
    return codes.where(F.col("code").isNotNull()).distinct()


def discovery_reasons(included: DataFrame, explanations: DataFrame, observed: DataFrame) -> DataFrame:
    """Why each representation was found.

    ``included``: representation_id, collection_id, version_id. ``explanations``: collection_id,
    dimension, code, name of the frozen query. ``observed``: version_id, dimension, code.
    """
    keys = ["representation_id", "collection_id", "version_id"]
    wanted = included.select(*keys).join(explanations, "collection_id")
    seen = observed.select("version_id", "dimension", "code", F.lit(True).alias("__seen"))
    judged = wanted.join(seen, ["version_id", "dimension", "code"], "left")
    label = F.concat(
        F.when(F.col("dimension") == "class", "Classe ").otherwise("Assunto "), F.col("code"), F.lit(" — "),
        F.col("name"),
    )
    # The explanations of one query are a short list, so each array here is short.
    part = F.struct("dimension", F.col("code").try_cast("decimal(38,0)").alias("number"), label.alias("label"))
    lists = judged.groupBy(*keys).agg(
        F.array_sort(F.collect_set(part)).alias("asked"),
        F.array_sort(F.collect_set(F.when(F.col("__seen"), part))).alias("found"),
    )
    texts = lists.select(
        *keys,
        F.when(F.size("found") > 0, F.array_join(F.col("found.label"), " + "))
        .otherwise(
            F.concat(
                F.lit("Critério consultado: "), F.array_join(F.col("asked.label"), "; "),
                F.lit(" (a captura não preserva código estruturado correspondente)"),
            )
        )
        .alias("reason"),
    )
    return texts.select("representation_id", "reason").distinct()


def refresh_targets(processes: DataFrame, representations: DataFrame, source: str, default: str = "TJGO") -> DataFrame:
    """The distinct tribunals to ask for each process; one without representations of the source asks the default."""
    known = representations.where(F.col("source") == source).select("process_id", "tribunal").distinct()
    return processes.select("process_id").join(known, "process_id", "left").withColumn("tribunal", F.coalesce("tribunal", F.lit(default)))


def watch_list(watchlist: DataFrame, page: int, size: int) -> DataFrame:
    """A page of the active entries, the latest inclusion first."""
    return page_of(watchlist.where("active"), page, size, F.desc("included_at"), F.col("process_id"))


def decision_page(history: DataFrame, process_id: object, page: int, size: int) -> DataFrame:
    """A page of one process's decision history, the newest version first."""
    return page_of(history.where(F.col("process_id") == process_id), page, size, F.desc("version"))


def definition_list(definitions: DataFrame, page: int, size: int, include_archived: bool = False) -> DataFrame:
    """A page of saved definitions, the newest first; archived ones only where asked for."""
    shown = definitions if include_archived else definitions.where("archived_at IS NULL")
    return page_of(shown, page, size, F.desc("created_at"), F.col("definition_id"))
