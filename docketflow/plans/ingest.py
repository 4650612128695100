"""From hits to facts: observations, versions, quarantine, and what is derived from them.

Order of observations of one representation: (observed_at, collection, page revision, hit
ordinal). File order and batch order never matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.functions import codes as C
from docketflow.functions import dates as D
from docketflow.functions import jsonvalue as J
from docketflow.operators import ordered as O
from docketflow.operators.steps import computed_once
from docketflow.sources.reference import canonical_tribunal

COVER_NORMALIZER = "cover-normalizer-v1"
OBSERVATION_ORDER = ["observed_at", "collection_id", "page_revision", "hit_ordinal"]
POSITION = ["collection_id", "page_key", "hit_ordinal"]
VERSION_KEYS = ["representation_id", "payload_sha256", "version_id"]

COVER_COLUMNS = [
    "class_code", "class_name", "grau", "court_unit_code", "court_unit_name",
    "filed_original", "filed_at", "filed_ambiguous",
    "updated_original", "updated_at", "updated_ambiguous",
]


def _identifier(*parts: Column) -> Column:
    """A short reproducible id of a natural key."""
    return F.md5(F.concat_ws("\u0001", *parts).cast("binary"))


def source_name(mode: Column) -> Column:
    return F.when(mode == "demo", "synthetic").otherwise("registry")


#: Leaves of a cover that are read, by name and path.
_LEAVES = {
    "id": "$.id",
    "number": "$.numeroProcesso",
    "tribunal": "$.tribunal",
    "class_code": "$.classe.codigo",
    "class_name": "$.classe.nome",
    "grau": "$.grau",
    "unit_code": "$.orgaoJulgador.codigo",
    "unit_name": "$.orgaoJulgador.nome",
    "filed": "$.dataAjuizamento",
    "updated": '$["@timestamp"]',
}


def _leaf(name: str) -> tuple[Column, Column]:
    """(schema, text) of a leaf."""
    return F.col(f"__s_{name}"), F.col(f"__t_{name}")


def _string(name: str) -> Column:
    schema, text = _leaf(name)
    return F.when(schema == "STRING", text)


def _original(name: str) -> Column:
    """A source date as it came: text as it is, other values as JSON, null and missing as NULL."""
    schema, text = _leaf(name)
    return F.when(schema == "STRING", text).when(schema != "VOID", F.to_json(F.col(f"__v_{name}")))


def prepare_hits(hits: DataFrame) -> DataFrame:
    """Validate covers and project their fields.

    ``hits`` has the page columns plus page_key, hit_ordinal and the hit's text. Adds the first
    failing check as (error_path, validation_code), both NULL for a valid hit.

    The work is laid out in steps that each read columns of the step before. A value that is used
    several times is thereby computed once, and the generated code stays small.
    """
    kept = hits.columns
    parsed = hits.select(*kept, F.try_parse_json("hit").alias("__hit"))
    # Every leaf is a column of its own, read from the whole hit, so a plan reads those that it needs.
    paths = {"hit_id": "$._id", **{name: "$._source" + path[1:] for name, path in _LEAVES.items()}}
    opened = parsed.select(
        *kept, "__hit", canonical_tribunal(F.col("tribunal")).alias("__expected"),
        *[J.get(F.col("__hit"), path).alias(f"__v_{name}") for name, path in paths.items()],
    )
    typed = opened.select(
        *kept, "__hit", "__expected", "__v_filed", "__v_updated",
        *[F.schema_of_variant(f"__v_{name}").alias(f"__s_{name}") for name in paths],
        *[J.get(F.col(f"__v_{name}"), "$", "string").alias(f"__t_{name}") for name in paths],
    )
    texts = typed.select("*", *[_string(name).alias(f"__x_{name}") for name in ("id", "hit_id", "number", "tribunal")])
    blank = r"(?U)^[\s\x1c-\x1f]*$"

    def failed(check: Column) -> Column:
        return F.coalesce(check, F.lit(True))

    # Only an object has an id, so the kind is asked for where there is none.
    no_object = F.col("__x_id").isNull() & J.get(F.col("__hit"), "$._source", "map<string,variant>").isNull()
    checks = [
        (no_object, "_source", "COVER_NOT_OBJECT"),
        (failed(F.col("__x_id").rlike(blank)), "_source.id", "SOURCE_ID_INVALID"),
        (failed(F.col("__x_hit_id").rlike(blank)), "_id", "HIT_SOURCE_ID_INVALID"),
        (failed(F.col("__x_id") != F.col("__x_hit_id")), "_source.id", "SOURCE_ID_MISMATCH"),
        (failed(~F.col("__x_number").rlike("^[0-9]{20}$")), "_source.numeroProcesso", "CNJ_INVALID"),
        (failed(F.col("__x_tribunal") != F.col("__expected")), "_source.tribunal", "TRIBUNAL_INVALID"),
    ]
    failing = F.lit(None).cast("int")
    for index in reversed(range(len(checks))):
        failing = F.when(checks[index][0], F.lit(index)).otherwise(failing)
    valid, odd = F.col("__failing").isNull(), F.col("__odd")
    # The text of a part keeps its numbers as written; it is cut out only where that matters.
    exact_source = F.from_json(F.col("hit"), "_source STRING")["_source"]
    judged = texts.withColumn("__failing", failing)
    judged = judged.withColumn("__odd", F.when(F.col("__failing").isNull(), J.needs_exact(F.col("hit"))))
    staged = judged.select(
        *kept,
        "__failing",
        source_name(F.col("mode")).alias("source"),
        F.col("responded_at").alias("observed_at"),
        F.col("__x_id").alias("source_id"),
        F.col("__x_number").alias("process_number"),
        # Only a valid hit has a payload; the text of a rejected one is its hit.
        F.when(valid, F.when(odd, exact_source)).alias("__exact"),
        F.when(valid, F.when(~odd, J.get(F.col("__hit"), "$._source", "string"))).alias("__native"),
        C.cover_code(*_leaf("class_code")).alias("class_code"),
        C.cover_text(*_leaf("class_name")).alias("class_name"),
        C.cover_text(*_leaf("grau")).alias("grau"),
        C.cover_code(*_leaf("unit_code")).alias("court_unit_code"),
        C.cover_text(*_leaf("unit_name")).alias("court_unit_name"),
        _original("filed").alias("filed_original"),
        _original("updated").alias("updated_original"),
    )
    dated = staged.select(
        "*",
        D.readable(F.col("filed_original")).alias("__filed"), D.readable(F.col("updated_original")).alias("__updated"),
        J.rewrite(F.col("__native"), F.col("__exact")).alias("payload"),
    )
    filed, updated = D.parsed(F.col("__filed")), D.parsed(F.col("__updated"))
    hashed = dated.select(
        "*",
        filed.wall.alias("__filed_wall"), filed.aware.alias("__filed_aware"), filed.instant.alias("filed_at"),
        updated.wall.alias("__updated_wall"), updated.aware.alias("__updated_aware"), updated.instant.alias("updated_at"),
        J.content_hash(F.col("payload")).alias("payload_sha256"),
        _identifier(F.col("source"), F.col("tribunal"), F.col("source_id")).alias("representation_id"),
    )
    places = F.array(*[F.lit(path) for _, path, _ in checks])
    codes = F.array(*[F.lit(code) for _, _, code in checks])
    out = hashed.select(
        *kept, "source", "observed_at", "source_id", "process_number",
        F.get(places, "__failing").alias("error_path"), F.get(codes, "__failing").alias("validation_code"),
        "representation_id", "payload", "class_code", "class_name", "grau", "court_unit_code", "court_unit_name",
        "filed_original", "filed_at",
        (F.col("__filed_wall").isNotNull() & ~F.col("__filed_aware")).alias("filed_ambiguous"),
        "updated_original", "updated_at",
        (F.col("__updated_wall").isNotNull() & ~F.col("__updated_aware")).alias("updated_ambiguous"),
        "payload_sha256",
        _identifier(F.col("representation_id"), F.col("payload_sha256")).alias("version_id"),
    )
    return computed_once(out)


def valid_hits(prepared: DataFrame) -> DataFrame:
    return prepared.where(F.col("validation_code").isNull())


def cover_rejections(prepared: DataFrame) -> DataFrame:
    """Quarantine rows of hits whose cover is invalid."""
    return prepared.where(F.col("validation_code").isNotNull()).select(
        *POSITION, "page_revision", "tribunal", "mode", "error_path", "validation_code",
        F.lit(COVER_NORMALIZER).alias("normalizer_version"), "hit",
        F.col("observed_at").alias("first_observed_at"),
    )


def versions(valid: DataFrame) -> DataFrame:
    """One row per distinct payload of a representation, at its first observation.

    All columns travel to the first observation, so plans that read a few of them give only those
    besides the two keys and the order; columns that ``valid`` lacks are left out.
    """
    columns = [
        "representation_id", "payload_sha256", "version_id", "process_number", "source", "tribunal",
        "source_id", "payload", *COVER_COLUMNS, *OBSERVATION_ORDER,
    ]
    first = O.earliest(valid.select(*[name for name in columns if name in valid.columns]), ["representation_id", "payload_sha256"], OBSERVATION_ORDER)
    return first.withColumnRenamed("observed_at", "first_observed_at").drop(*OBSERVATION_ORDER[1:])


#: What an observation is made of.
OBSERVED = [
    *POSITION, "page_revision", "representation_id", "version_id", "process_number",
    "observed_at", "payload_sha256", "filed_original",
]


def observations(valid: DataFrame) -> DataFrame:
    """One row per observed hit with its outcome against the observation before it.

    A payload that returns after another one counts as updated.
    """
    return observations_of(valid.select(*OBSERVED))


def observations_of(seen: DataFrame) -> DataFrame:
    """Outcomes of stored positions, see :func:`observations`."""
    chained = O.previous_values(
        seen, ["representation_id"], OBSERVATION_ORDER, O.time_bucket(F.col("observed_at")),
        ["payload_sha256", "filed_original", "version_id"],
    )
    outcome = (
        F.when(~F.col("prev_exists"), "new")
        .when(F.col("prev_payload_sha256") != F.col("payload_sha256"), "updated")
        .otherwise("unchanged")
    )
    went_back = D.regressed(F.col("prev_filed_original"), F.col("filed_original"))
    return chained.select(
        *POSITION, "page_revision", "representation_id", "version_id", "process_number", "observed_at",
        outcome.alias("capture_outcome"),
        went_back.alias("filed_regressed"),
        F.when(went_back, F.col("prev_version_id")).alias("regressed_from_version_id"),
    )


def processes(valid: DataFrame) -> DataFrame:
    """One row per case number."""
    return valid.groupBy("process_number").agg(F.min("observed_at").alias("created_at"))


def representations(observed: DataFrame, stored_versions: DataFrame) -> DataFrame:
    """The latest projection: the version of the last observation and when it was last seen.

    It has the cover columns that ``stored_versions`` has.
    """
    last = O.latest(
        observed.select("representation_id", "version_id", *OBSERVATION_ORDER),
        ["representation_id"], OBSERVATION_ORDER,
    ).select("representation_id", F.col("version_id").alias("latest_version_id"),
             F.col("observed_at").alias("last_observed_at"))
    cover = stored_versions.select(
        F.col("version_id").alias("latest_version_id"),
        *[name for name in ("process_number", "source", "tribunal", "source_id", *COVER_COLUMNS) if name in stored_versions.columns],
    )
    return last.join(cover, "latest_version_id")


def subjects(stored_versions: DataFrame) -> DataFrame:
    """Subjects of each version, numbered after the empty ones are left out."""
    items = J.get(F.try_parse_json("payload"), "$.assuntos", "array<variant>")
    opened = stored_versions.select("version_id", "representation_id", items.alias("items"))
    leaves = F.transform(
        "items",
        lambda item: F.struct(J.get(item, "$.codigo").alias("code"), J.get(item, "$.nome").alias("name")),
    )
    pairs = F.transform(
        leaves,
        lambda p: F.struct(
            C.cover_code(*C.leaf(p["code"])).alias("subject_code"), C.cover_text(*C.leaf(p["name"])).alias("subject_name")
        ),
    )
    kept = F.filter(pairs, lambda p: p["subject_code"].isNotNull() | p["subject_name"].isNotNull())
    return opened.select("version_id", "representation_id", F.posexplode(kept).alias("pos", "s")).select(
        "version_id", "representation_id", (F.col("pos") + 1).alias("ordinal"), "s.subject_code", "s.subject_name"
    )


def collection_results(observed: DataFrame) -> DataFrame:
    """The first inclusion of each representation in each collection."""
    first = O.earliest(
        observed.select("collection_id", "representation_id", "page_revision", "hit_ordinal",
                        "observed_at", "capture_outcome", "version_id"),
        ["collection_id", "representation_id"], ["page_revision", "hit_ordinal", "observed_at"],
    )
    return first.withColumnRenamed("observed_at", "included_at")


def page_counts(observed: DataFrame) -> DataFrame:
    """Per page: distinct representations by the outcome of their first hit on it."""
    first = O.earliest(
        observed.select("page_key", "collection_id", "page_revision", "representation_id", "hit_ordinal",
                        "capture_outcome"),
        ["page_key", "representation_id"], ["hit_ordinal"],
    )
    outcome = F.col("capture_outcome")
    return first.groupBy("collection_id", "page_revision", "page_key").agg(
        F.count_if(outcome == "new").alias("new"),
        F.count_if(outcome == "updated").alias("updated"),
        F.count_if(outcome == "unchanged").alias("unchanged"),
    )


def origin_conflicts(valid: DataFrame) -> DataFrame:
    """Origins that claim more than one case number."""
    return (
        valid.groupBy("source", "tribunal", "source_id")
        .agg(F.min("process_number").alias("low"), F.max("process_number").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("source", "tribunal", "source_id")
    )


def replay_conflicts(batch: DataFrame, stored: DataFrame, content: str) -> DataFrame:
    """Positions that were seen before with other content. A faithful replay gives no rows."""
    before = stored.select(*POSITION, F.col(content).alias("stored_content"))
    return (
        batch.select(*POSITION, F.col(content).alias("replayed_content"))
        .join(before, POSITION)
        .where(~F.col("stored_content").eqNullSafe(F.col("replayed_content")))
    )


def replay_gaps(positions: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Pages whose stored positions are not exactly 1..n for the replayed size n."""
    stored = positions.select("page_key", "hit_ordinal").distinct().groupBy("page_key").agg(
        F.count(F.lit(1)).alias("stored"), F.min("hit_ordinal").alias("lowest"), F.max("hit_ordinal").alias("highest")
    )
    whole = (F.col("stored") == F.col("hits")) & (F.col("lowest") == 1) & (F.col("highest") == F.col("hits"))
    return page_sizes.select("page_key", "hits").join(stored, "page_key").where(~whole)


@dataclass(frozen=True)
class Facts:
    """What one batch of hits adds."""

    prepared: DataFrame
    valid: DataFrame
    versions: DataFrame
    rejections: DataFrame


def facts(hits: DataFrame) -> Facts:
    prepared = prepare_hits(hits)
    valid = valid_hits(prepared)
    return Facts(prepared, valid, versions(valid), cover_rejections(prepared))
