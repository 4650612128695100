"""Process filters: every read that slices by process uses the same cut.

All conditions are ANDed. Conditions on representations must hold for one and the same
representation, so they end in a single semi-join and process rows never multiply.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.functions import text as X
from docketflow.sources.reference import active_rules, checked_tribunal

MAX_TRIBUNALS = 33


@dataclass(frozen=True)
class ProcessFilters:
    tribunals: tuple[str, ...] | None = None
    process_number: str | None = None
    subject: str | None = None
    subject_code: str | None = None
    subject_name_exact: str | None = None
    class_filter: str | None = None
    court_unit: str | None = None
    collection_id: str | None = None
    preset_id: str | None = None
    decision: str | None = None
    rural_link: str | None = None
    followed: bool | None = None
    pending_news: bool | None = None
    signal_category: str | None = None

    def resolved(self) -> ProcessFilters:
        """Trimmed, checked arguments; blank texts count as not given."""
        changes: dict[str, object] = {}
        for name in ("subject", "subject_code", "subject_name_exact", "class_filter", "court_unit",
                     "preset_id", "signal_category"):
            value = getattr(self, name)
            changes[name] = value.strip() if value else None
        if self.process_number is not None:
            changes["process_number"] = checked_case_number(self.process_number)
        if self.tribunals is not None:
            if not 1 <= len(self.tribunals) <= MAX_TRIBUNALS:
                raise ValueError(f"select 1 to {MAX_TRIBUNALS} tribunals")
            names = tuple(checked_tribunal(value) for value in self.tribunals)
            if len(set(names)) != len(names):
                raise ValueError("a tribunal is selected twice")
            changes["tribunals"] = names
        return replace(self, **changes)


def checked_case_number(value: str) -> str:
    """Argument form of the case number rule."""
    if not re.fullmatch(r"[0-9]{20}|[0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2}\.[0-9]{4}", value):
        raise ValueError(f"not a case number: {value!r}")
    return re.sub("[^0-9]", "", value)


@dataclass(frozen=True)
class CaseTables:
    """The tables reads work on. Tables a read does not touch may be left out."""

    processes: DataFrame
    representations: DataFrame
    subjects: DataFrame | None = None
    triage: DataFrame | None = None
    watchlist: DataFrame | None = None
    news: DataFrame | None = None
    signals: DataFrame | None = None
    results: DataFrame | None = None
    collections: DataFrame | None = None
    runs: DataFrame | None = None
    rules: DataFrame | None = None


def with_triage(processes: DataFrame, triage: DataFrame) -> DataFrame:
    """Add decision and link; a process without a row is pending and unconfirmed."""
    state = triage.select("process_id", "decision", "rural_link")
    return processes.join(state, "process_id", "left").withColumns(
        {
            "decision": F.coalesce("decision", F.lit("pending")),
            "rural_link": F.coalesce("rural_link", F.lit("unconfirmed")),
        }
    )


def matching_representations(tables: CaseTables, filters: ProcessFilters) -> DataFrame | None:
    """Representations that meet all representation conditions; None when there is none."""
    chosen = tables.representations
    conditions: list[Column] = []
    if filters.tribunals is not None:
        conditions.append(F.col("tribunal").isin(*filters.tribunals))
    if filters.class_filter is not None:
        conditions.append(_name_or_code("class_name", "class_code", filters.class_filter))
    if filters.court_unit is not None:
        conditions.append(_name_or_code("court_unit_name", "court_unit_code", filters.court_unit))
    for condition in conditions:
        chosen = chosen.where(condition)
    restricted = bool(conditions)
    if filters.subject is not None:
        hits = tables.subjects.where(_name_or_code("subject_name", "subject_code", filters.subject))
        chosen, restricted = chosen.join(hits, "representation_id", "left_semi"), True
    if filters.subject_code is not None or filters.subject_name_exact is not None:
        exact = tables.subjects
        if filters.subject_code is not None:
            exact = exact.where(F.col("subject_code") == filters.subject_code)
        if filters.subject_name_exact is not None:
            exact = exact.where(F.col("subject_name") == filters.subject_name_exact)
        chosen, restricted = chosen.join(exact, "representation_id", "left_semi"), True
    if filters.collection_id is not None or filters.preset_id is not None:
        runs = tables.runs
        if filters.preset_id is not None:
            runs = runs.where(F.get_json_object("parameters", "$.query.preset_id") == filters.preset_id)
        seen = tables.results
        if filters.collection_id is not None:
            seen = seen.where(F.col("collection_id") == filters.collection_id)
        seen = seen.join(runs, "collection_id", "left_semi")
        chosen, restricted = chosen.join(seen, "representation_id", "left_semi"), True
    return chosen if restricted else None


def _name_or_code(name: str, code: str, needle: str) -> Column:
    return X.contains_ignoring_case(F.col(name), needle) | X.contains_ignoring_case(F.col(code), needle)


def current_signals(signals: DataFrame, rules: DataFrame, environment: str) -> DataFrame:
    """Published, current signals of rules that are enabled at exactly that version."""
    enabled = active_rules(rules, environment).select("rule_id", "rule_version")
    live = signals.where(
        F.col("is_published") & F.col("is_current") & (F.col("environment") == environment)
    )
    return live.join(enabled, ["rule_id", "rule_version"], "left_semi")


def select_processes(tables: CaseTables, filters: ProcessFilters, environment: str = "demo") -> DataFrame:
    """The process rows that meet every given filter."""
    filters = filters.resolved()
    chosen = tables.processes
    columns = chosen.columns
    if filters.process_number is not None:
        chosen = chosen.where(F.col("process_number") == filters.process_number)
    if filters.decision is not None or filters.rural_link is not None:
        judged = with_triage(chosen, tables.triage)
        if filters.decision is not None:
            judged = judged.where(F.col("decision") == filters.decision)
        if filters.rural_link is not None:
            judged = judged.where(F.col("rural_link") == filters.rural_link)
        chosen = judged.select(*columns)
    matching = matching_representations(tables, filters)
    if matching is not None:
        chosen = chosen.join(matching, "process_id", "left_semi")
    if filters.followed is not None:
        active = tables.watchlist.where("active")
        chosen = chosen.join(active, "process_id", "left_semi" if filters.followed else "left_anti")
    if filters.pending_news is not None:
        pending = tables.news.where("status = 'pending'")
        chosen = chosen.join(pending, "process_id", "left_semi" if filters.pending_news else "left_anti")
    if filters.signal_category is not None:
        signalled = current_signals(tables.signals, tables.rules, environment).where(
            F.col("category") == filters.signal_category
        )
        chosen = chosen.join(signalled, "process_id", "left_semi")
    return chosen


@dataclass(frozen=True)
class DiscoveryQuery:
    """What a collection asks its source for; dates form a half-open range."""

    tribunal: str
    filed_from: str | None = None
    filed_to: str | None = None
    class_codes: tuple[int, ...] = ()
    subject_codes: tuple[int, ...] = ()
    movement_codes: tuple[int, ...] = ()
    combine: str = "AND"
    court_unit_code: int | None = None
    process_number: str | None = None

    def checked(self) -> DiscoveryQuery:
        if self.combine not in ("AND", "OR"):
            raise ValueError("combine must be AND or OR")
        if (self.filed_from is None) != (self.filed_to is None):
            raise ValueError("a filing range needs both ends")
        if self.filed_from is not None and self.filed_from >= self.filed_to:
            raise ValueError("a filing range must not be empty")
        for codes in (self.class_codes, self.subject_codes, self.movement_codes):
            if any(isinstance(code, bool) or not isinstance(code, int) or code <= 0 for code in codes):
                raise ValueError("codes are positive integers")
        if self.court_unit_code is not None and self.court_unit_code <= 0:
            raise ValueError("codes are positive integers")
        if self.process_number is not None and not re.fullmatch("[0-9]{20}", self.process_number):
            raise ValueError("a case number here has exactly 20 digits")
        given = (self.process_number, self.filed_from, self.court_unit_code)
        if not (self.class_codes or self.subject_codes or self.movement_codes) and all(g is None for g in given):
            raise ValueError("give at least one filter")
        return replace(
            self,
            tribunal=checked_tribunal(self.tribunal),
            class_codes=tuple(sorted(set(self.class_codes))),
            subject_codes=tuple(sorted(set(self.subject_codes))),
            movement_codes=tuple(sorted(set(self.movement_codes))),
        )


def discover(records: DataFrame, query: DiscoveryQuery) -> DataFrame:
    """Records that a query asks for.

    ``records`` has tribunal, process_number, filed_on, class_code, court_unit_code and the
    arrays subject_codes and movement_codes.
    """
    query = query.checked()
    out = records.where(F.col("tribunal") == query.tribunal)
    if query.process_number is not None:
        out = out.where(F.col("process_number") == query.process_number)
    if query.filed_from is not None:
        day = F.col("filed_on")
        out = out.where((day >= F.lit(query.filed_from).cast("date")) & (day < F.lit(query.filed_to).cast("date")))
    by_class = F.col("class_code").isin(*query.class_codes) if query.class_codes else None
    by_subject = _any_of("subject_codes", query.subject_codes) if query.subject_codes else None
    if by_class is not None and by_subject is not None and query.combine == "OR":
        out = out.where(F.coalesce(by_class, F.lit(False)) | by_subject)
    else:
        for condition in (by_class, by_subject):
            if condition is not None:
                out = out.where(condition)
    if query.movement_codes:
        out = out.where(_any_of("movement_codes", query.movement_codes))
    if query.court_unit_code is not None:
        out = out.where(F.col("court_unit_code") == query.court_unit_code)
    return out


def _any_of(column: str, codes: tuple[int, ...]) -> Column:
    """True when the array holds one of the codes; a NULL element proves nothing."""
    wanted = F.array(*[F.lit(code).cast("long") for code in codes])
    return F.coalesce(F.arrays_overlap(F.col(column).cast("array<bigint>"), wanted), F.lit(False))
