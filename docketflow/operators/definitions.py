"""Decisions, saved definitions, schedules and catalog gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.functions import dates as D
from docketflow.functions import jsonvalue as J
from docketflow.operators import ordered as O

DECISION_STATE = ["decision", "rural_link", "note"]


def fold_decisions(log: DataFrame, order: Sequence[str], bucket: Column) -> DataFrame:
    """Versioned decision history from a log of complete, already accepted states.

    A state equal to the one before changes nothing. The implicit first state is pending,
    unconfirmed and without note. A confirmed link needs a note.
    """
    usable = log.withColumn("note", F.trim(F.coalesce("note", F.lit("")))).where(
        (F.col("rural_link") != "confirmed") | (F.col("note") != "")
    )
    chained = O.previous_values(usable, ["process_id"], list(order), bucket, DECISION_STATE)
    start = {"decision": "pending", "rural_link": "unconfirmed", "note": ""}
    changed = F.lit(False)
    for name in DECISION_STATE:
        changed = changed | (F.col(name) != F.coalesce(f"prev_{name}", F.lit(start[name])))
    changes = chained.where(changed).select(*usable.columns)
    return O.running_totals(changes, ["process_id"], list(order), bucket, {"version": F.lit(1)})


def fold_requests(requests: DataFrame, order: Sequence[str]) -> DataFrame:
    """Decision history from requests that name the version they expect.

    A NULL field keeps its current value. A request is accepted when it is the earliest one, in
    log order and after the acceptance of the version it expects, that changes something; others
    conflict or change nothing, and a confirmed link without a note is refused. One round settles
    one version of every process at once: it picks the earliest candidate per process with a
    partial aggregate, so a busy process never meets in one task. Requests are written by expected
    version and a round reads its own version only. Rounds end by themselves when no process accepts anything
    more; each round's rows are written apart and all are read together at the end.
    """
    from docketflow.session import cut_lineage, stored, working_folder

    spark = requests.sparkSession
    rows = stored(
        requests.select(
            "process_id", "expected_version", "decision", "rural_link", F.trim("note").alias("note"),
            F.struct(*[F.col(name) for name in order]).alias("__at"),
        ),
        ["expected_version"],
    )
    folder = working_folder(spark)
    settled = rows.groupBy("process_id").agg(F.lit(0).alias("version")).withColumns(
        {"decision": F.lit("pending"), "rural_link": F.lit("unconfirmed"), "note": F.lit(""),
         "__at": F.lit(None).cast(rows.schema["__at"].dataType)}
    )
    version = 0
    while True:
        version += 1
        before = settled.select(
            "process_id", F.col("__at").alias("__after"), *[F.col(n).alias(f"__{n}") for n in DECISION_STATE]
        )
        candidates = rows.where(F.col("expected_version") == version - 1).join(before, "process_id").where(
            F.col("__after").isNull() | (F.col("__at") > F.col("__after"))
        )
        merged = candidates.withColumns({n: F.coalesce(n, f"__{n}") for n in DECISION_STATE})
        changed = F.lit(False)
        for name in DECISION_STATE:
            changed = changed | (F.col(name) != F.col(f"__{name}"))
        allowed = (F.col("rural_link") != "confirmed") | (F.col("note") != "")
        packed = F.struct("__at", *DECISION_STATE)
        accepted = merged.where(changed & allowed).groupBy("process_id").agg(F.min_by(packed, "__at").alias("__row")).select(
            "process_id", F.lit(version).alias("version"), "__row.*"
        )
        path = f"{folder}/round={version}"
        accepted.write.parquet(path)
        settled = spark.read.schema(accepted.schema).parquet(path)
        if settled.isEmpty():
            history = spark.read.schema(accepted.schema).parquet(folder)
            return history.select("process_id", "version", *DECISION_STATE, F.col("__at").alias("accepted_at"))


def current_decisions(history: DataFrame) -> DataFrame:
    """The state after the last version."""
    return O.latest(history, ["process_id"], ["version"])


def definition_versions(log: DataFrame, key: str, content: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Numbered versions of saved definitions; saving an equal content makes no new version."""
    chained = O.previous_values(log, [key], list(order), bucket, list(content))
    same = F.lit(True)
    for name in content:
        same = same & F.col(name).eqNullSafe(F.col(f"prev_{name}"))
    changed = chained.where(~F.col("prev_exists") | ~same).select(*log.columns)
    return O.running_totals(changed, [key], list(order), bucket, {"version": F.lit(1)})


def definition_drift(saved: DataFrame, items: DataFrame) -> DataFrame:
    """Saved definitions that no longer fit the catalog, with the reason.

    ``saved``: saved_id, item_id, item_version, codes. ``items``: item_id, version, codes. Codes
    are sorted distinct arrays.
    """
    current = items.select("item_id", F.col("version").alias("__version"), F.col("codes").alias("__codes"))
    reason = F.when(F.col("__version") != F.col("item_version"), "SAVED_PRESET_VERSION_CHANGED").when(
        ~F.col("__codes").eqNullSafe(F.col("codes")), "SAVED_PRESET_FILTERS_CHANGED"
    )
    return saved.join(current, "item_id").select("saved_id", "item_id", reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def due_report(targets: DataFrame, as_of: Column) -> DataFrame:
    """Enabled targets that are due, and the local date each would run for."""
    due = targets.where(F.col("enabled") & (F.col("next_run_at") <= as_of))
    return due.select(
        "target_id", "next_run_at", D.local_date(F.col("next_run_at")).alias("due_date"),
        (F.col("next_run_at") < as_of).alias("missed"), D.next_daily_run(as_of).alias("following_run_at"),
    )


def coalesced_misses(dispatches: DataFrame) -> DataFrame:
    """Missed days of a target folded into one range; missing ends are ignored."""
    return dispatches.groupBy("target_id").agg(
        F.min("missed_from").alias("missed_from"), F.max("missed_through").alias("missed_through"),
        F.count(F.lit(1)).alias("dispatches"),
    )


def operation_key(kind: Column, source: Column, tribunal: Column, query: Column) -> Column:
    """The identity of a run: what it does, not when. ``query`` is canonical JSON."""
    return J.content_hash(
        J.json_object(
            ("query", query), ("source", J.quoted(source)), ("tribunal", J.quoted(tribunal)), ("type", J.quoted(kind))
        )
    )


def active_operations(runs: DataFrame, order: Sequence[str]) -> DataFrame:
    """One open run per operation: the first one; equal requests join it."""
    active = runs.where(F.col("status").isin("queued", "running", "retry_wait"))
    return O.earliest(active, ["operation_key"], list(order))


def code_picker(codes: DataFrame, dimension: str, query: str = "") -> DataFrame:
    """Active, usable codes offered for custom definitions, by number and name."""
    needle = query.strip().lower()
    usable = F.col("selectable_for_custom") & (F.col("situation") == "A") & (
        F.col("tjgo_first_grade") | F.col("tjgo_second_grade")
    )
    out = codes.where((F.col("dimension") == dimension) & usable)
    if needle:
        out = out.where(
            F.contains(F.col("code").cast("string"), F.lit(needle)) | F.contains(F.lower("name"), F.lit(needle))
        )
    return out.orderBy("code", "name")


def inclusion_explanations(item_codes: DataFrame, codes: DataFrame, items: DataFrame) -> DataFrame:
    """Why a hit counts for an item: each code with its name and how it combines."""
    named = item_codes.join(codes.select("dimension", "code", "name"), ["dimension", "code"])
    return named.join(items.select("item_id", "combine"), "item_id").select(
        "item_id", "dimension", "code", "name",
        F.concat(F.lit("OR within this filter; "), F.col("combine"), F.lit(" with other non-empty dimensions")).alias("condition"),
    )


def evidence_gate(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether an item may run for real: every required evidence has to be validated.

    ``items``: item_id, required (array of evidence names), runtime_implemented. ``evidence``:
    item_id, evidence_name, state, reason.
    """
    needed = items.select("item_id", F.explode("required").alias("evidence_name"))
    judged = needed.join(evidence, ["item_id", "evidence_name"], "left")
    failed = F.coalesce(F.col("state") != "validated", F.lit(True))
    text = F.concat(
        F.col("evidence_name"), F.lit(": "), F.coalesce("state", F.lit("missing")), F.lit(" — "),
        F.coalesce("reason", F.lit("")),
    )
    # An item requires a handful of evidence names, so its list of reasons is short.
    reasons = judged.groupBy("item_id").agg(F.array_sort(F.collect_set(F.when(failed, text))).alias("reasons"))
    joined = items.select("item_id", "runtime_implemented").join(reasons, "item_id", "left")
    listed = F.coalesce("reasons", F.array().cast("array<string>"))
    return joined.select(
        "item_id",
        ((F.size(listed) == 0) & F.col("runtime_implemented")).alias("enabled"),
        F.array_join(listed, "; ").alias("reasons"),
    )


def group_rollup(members: DataFrame) -> DataFrame:
    """State, progress and fingerprint of execution groups from their members.

    ``members``: group_id, tribunal, state, operation, updated_at. A group has at most one member
    per tribunal, so its fingerprint reads a list of at most 33 entries.
    """
    state = F.col("state")

    def some(*names: str) -> Column:
        return F.count_if(state.isin(*names)) > 0

    def every(*names: str) -> Column:
        return F.count_if(~state.isin(*names)) == 0

    done = some("COMPLETED", "PARTIAL")
    issue = some("PARTIAL", "FAILED", "BLOCKED_NOT_VALIDATED", "NOT_RUN", "CANCELLED")
    rolled = (
        F.when(some("RUNNING", "RETRY_WAIT"), "running")
        .when(some("QUEUED"), "queued")
        .when(done & issue, "partial")
        .when(every("BLOCKED_NOT_VALIDATED", "NOT_RUN"), "blocked")
        .when(some("FAILED") & ~done, "failed")
        .when(every("CANCELLED", "BLOCKED_NOT_VALIDATED", "NOT_RUN"), "cancelled")
        .when(every("COMPLETED"), "completed")
        .otherwise("failed")
    )
    completed = F.count_if(state.isin("COMPLETED", "PARTIAL"))
    total = F.count(F.lit(1))
    return members.groupBy("group_id").agg(
        rolled.alias("group_state"),
        total.alias("member_count"),
        completed.alias("completed_count"),
        F.floor(completed * 100 / total).cast("long").alias("percent"),
        F.max("updated_at").alias("updated_at"),
    )


def group_fingerprints(members: DataFrame) -> DataFrame:
    """Target, kind and the operations of a group in tribunal order, as canonical text and hashed.

    ``members``: group_id, target_id, kind, mode, type, source, tribunal, and query and sort as canonical JSON
    texts. Equal members are listed as often as they occur.
    """
    operation = J.json_object(
        *[(name, F.col(name) if name in ("query", "sort") else J.quoted(F.col(name))) for name in ("mode", "query", "sort", "source", "tribunal", "type")]
    )
    listed = F.array_sort(F.collect_list(F.struct("tribunal", operation.alias("text"))))
    grouped = members.groupBy("group_id", "target_id", "kind").agg(F.transform(listed, lambda x: x["text"]).alias("texts"))
    whole = J.json_object(
        ("kind", J.quoted(F.col("kind"))), ("operations", F.concat(F.lit("["), F.array_join("texts", ","), F.lit("]"))),
        ("target_id", J.quoted(F.col("target_id"))),
    )
    return grouped.select("group_id", J.content_hash(whole).alias("fingerprint"))


def last_activity(*moments: Column) -> Column:
    """The latest of several moments; missing ones are ignored."""
    return F.greatest(*moments)


#: What a source query fixes, by kind of value, in key order.
CRITERIA = {
    "class_codes": "list", "court_unit_code": "text", "dimension_combination": "text", "filed_from": "date", "filed_to": "date", "movement_codes": "list",
    "preset_id": "text", "preset_version": "number", "process_number": "text", "subject_codes": "list", "tribunal": "text",
}


def frozen_criteria(requests: DataFrame) -> DataFrame:
    """Requests with ``criteria``, the snapshot of what they ask for, and ``operation_key``, the hash that tells equal ones.

    ``requests`` has the columns of ``CRITERIA``, ``source``, ``job_type``, and ``sort`` as (field_name, order) pairs; lists keep their order. The
    snapshot is one canonical JSON text with keys in order, so a later change of a catalog or a window shows as another key.
    """
    def text(kind: str, value: Column) -> Column:
        if kind == "list":
            spelled = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: J.quoted(v.cast("string"))), ","), F.lit("]"))
            return F.coalesce(spelled, F.lit("[]"))
        plain = value.cast("string")
        return F.coalesce(plain if kind == "number" else J.quoted(plain), F.lit("null"))

    asked = J.json_object(*[(name, text(kind, F.col(name))) for name, kind in CRITERIA.items()])
    term = lambda t: J.json_object(("field_name", J.quoted(t["field_name"])), ("order", J.quoted(t["order"])))
    sort = F.concat(F.lit("["), F.array_join(F.transform("sort", term), ","), F.lit("]"))
    whole = J.json_object(
        ("query", asked), ("sort", sort), ("source", J.quoted(F.col("source"))), ("tribunal", J.quoted(F.col("tribunal"))), ("type", J.quoted(F.col("job_type"))),
    )
    return requests.withColumn("criteria", whole).withColumn("operation_key", J.content_hash(F.col("criteria")))


def criteria_drift(before: DataFrame, now: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests of two revisions side by side: criteria and key of now, the key before, and whether they differ."""
    old = before.select(*keys, F.col("operation_key").alias("previous_key"))
    return now.join(old, list(keys), "left").withColumn("changed", ~F.col("operation_key").eqNullSafe(F.col("previous_key")))
