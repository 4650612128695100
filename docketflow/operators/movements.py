"""Movement arrays of a payload: classification, normalisation, occurrences, snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.functions import codes as C
from docketflow.functions import dates as D
from docketflow.functions import jsonvalue as J
from docketflow.functions.exact import KNOWN_FIELDS, movement_parts
from docketflow.operators import reconcile as R
from docketflow.operators.steps import computed_once

NORMALIZER_V1 = "movement-normalizer-v1"

_KEYS = ["representation_id", "version_id"]


def explode_movements(stored_versions: DataFrame) -> DataFrame:
    """One row per array element with its zero-based position.

    ``movement`` is the element's value, ``exact_text`` its text where the payload holds numbers
    that a VARIANT would rewrite.
    """
    value = F.try_parse_json("payload")
    items = J.get(value, "$.movimentos", "array<variant>")
    texts = F.from_json(F.col("payload"), "movimentos ARRAY<STRING>")["movimentos"]
    paired = F.when(
        J.needs_exact(F.col("payload")),
        F.zip_with(items, texts, lambda m, t: F.struct(m.alias("movement"), t.alias("exact_text"))),
    ).otherwise(
        F.transform(items, lambda m: F.struct(m.alias("movement"), F.lit(None).cast("string").alias("exact_text")))
    )
    return stored_versions.select(
        *_KEYS, "first_observed_at", F.posexplode(paired).alias("position", "item")
    ).select(*_KEYS, "first_observed_at", "position", "item.movement", "item.exact_text")


def array_issue(payload: Column) -> Column:
    """Why the movement array as a whole is no array; NULL when it is one."""
    value = F.try_parse_json(payload)
    field = J.get(value, "$.movimentos")
    # Nearly every field is an array, which settles it.
    return (
        F.when(J.get(value, "$.movimentos", "array<variant>").isNotNull(), F.lit(None).cast("string"))
        .when(field.isNull(), "MOVEMENTS_FIELD_MISSING")
        .when(J.is_json_null(field), "MOVEMENTS_NULL")
        .otherwise("MOVEMENTS_NOT_ARRAY")
    )


def _is_object_text(text: Column) -> Column:
    return F.coalesce(text.startswith("{"), F.lit(False))


def movement_issues(stored_versions: DataFrame, elements: DataFrame) -> DataFrame:
    """Array and element problems with their path and stable code."""
    whole = stored_versions.select(
        *_KEYS, F.lit("movimentos").alias("error_path"), array_issue(F.col("payload")).alias("validation_code")
    ).where(F.col("validation_code").isNotNull())
    single = elements.where(~J.is_object(F.col("movement"))).select(
        *_KEYS,
        F.concat(F.lit("movimentos["), F.col("position").cast("string"), F.lit("]")).alias("error_path"),
        F.lit("MOVEMENT_NOT_OBJECT").alias("validation_code"),
    )
    return whole.unionByName(single)


def _present(text: Column) -> Column:
    """Missing and null stay apart in the auxiliary key."""
    return F.when(text.isNull(), F.lit('{"present":false}')).otherwise(
        F.concat(F.lit('{"present":true,"value":'), text, F.lit("}"))
    )


_exact_normalized = F.pandas_udf(
    movement_parts,
    T.StructType([T.StructField("content", T.StringType()), T.StructField("auxiliary_key", T.StringType())]),
)


def normalize_v1(elements: DataFrame) -> DataFrame:
    """Canonical content, its hash and the auxiliary key of every object element.

    Unknown fields are kept, complements are sorted by canonical text with repeats, and the name
    takes no part in the auxiliary key.
    """
    movement = F.col("movement")
    kept = [name for name in elements.columns if name not in ("movement", "exact_text")]
    written = computed_once(elements.withColumn("__raw", F.to_json("movement"))).where(_is_object_text(F.col("__raw")))
    opened = written.select(
        *kept, "__raw", "exact_text",
        *[J.get(movement, f"$.{field}").alias(f"__{field}") for field in KNOWN_FIELDS],
        F.map_filter(
            J.get(movement, "$", "map<string,variant>"), lambda key, _: ~key.isin(*KNOWN_FIELDS)
        ).alias("__extras"),
    )
    # One text per field; NULL for a missing one.
    read = opened.select(
        *kept, "__raw", "exact_text",
        *[F.to_json(f"__{field}").alias(f"__j_{field}") for field in KNOWN_FIELDS if field != "complementosTabelados"],
        F.schema_of_variant("__codigo").alias("__code_schema"), J.get(F.col("__codigo"), "$", "string").alias("__code_text"),
        F.schema_of_variant("__dataHora").alias("__date_schema"), J.get(F.col("__dataHora"), "$", "string").alias("__date_text"),
        J.get(F.col("__complementosTabelados"), "$", "array<variant>").alias("__list"),
        F.to_json("__complementosTabelados").alias("__complement_json"),
        F.coalesce(F.when(F.size("__extras") > 0, F.to_json(F.to_variant_object("__extras"))), F.lit("{}")).alias("__extra_json"),
    )
    sorted_list = F.concat(
        F.lit("["), F.array_join(F.array_sort(F.transform("__list", lambda item: F.to_json(item))), ","), F.lit("]")
    )
    plain = read.withColumn(
        "__plain", D.readable(F.when(F.col("__date_schema") == "STRING", F.col("__date_text")), date_only=False)
    )
    date = D.parsed(F.col("__plain"))
    dated = plain.select(
        *kept, "__raw", "exact_text", "__j_codigo", "__j_dataHora", "__j_nome", "__j_orgaoJulgador", "__extra_json",
        "__code_schema", "__code_text", "__date_schema",
        F.coalesce(sorted_list, "__complement_json").alias("__complements"),
        date.wall.alias("__wall"), date.instant.alias("date_instant"), date.aware.alias("__aware"),
    )
    instant_text = F.when(F.col("__aware"), F.concat(D.iso_micros(F.col("date_instant")), F.lit("Z")))
    texts = dated.select(
        *kept, "__raw", "exact_text", "__j_codigo", "__j_dataHora", "__j_nome", "__j_orgaoJulgador", "__extra_json",
        "__complements", "date_instant",
        D.status(F.col("__date_schema"), F.col("__wall"), F.col("__aware")).alias("date_status"),
        C.rule_code(F.col("__code_schema"), F.col("__code_text")).alias("code"),
        ((F.col("__code_schema") != "VOID") & (F.col("__date_schema") != "VOID")).alias("__keyed"),
        F.coalesce(instant_text, D.iso_micros(F.col("__wall"))).alias("__normalized"),
        F.coalesce(F.concat(F.lit('"'), instant_text, F.lit('"')), "__j_dataHora").alias("__comparable"),
    )
    native_content = J.json_object(
        ("camposExtras", F.col("__extra_json")),
        ("codigo", F.col("__j_codigo")),
        ("complementosTabelados", F.col("__complements")),
        ("dataHora", F.col("__j_dataHora")),
        # These texts hold nothing that needs an escape.
        ("dataHoraNormalizada", F.concat(F.lit('"'), "__normalized", F.lit('"'))),
        ("dataHoraStatus", F.when(F.col("__j_dataHora").isNotNull(), F.concat(F.lit('"'), "date_status", F.lit('"')))),
        ("nome", F.col("__j_nome")),
        ("orgaoJulgador", F.col("__j_orgaoJulgador")),
    )
    native_key = F.when(
        F.col("__keyed"),
        J.json_object(
            ("codigo", F.col("__j_codigo")),
            ("complementosTabelados", _present(F.col("__complements"))),
            ("dataHora", F.col("__comparable")),
            ("orgaoJulgador", _present(F.col("__j_orgaoJulgador"))),
        ),
    )
    both = texts.select(
        *kept, "exact_text", "date_status", "date_instant", "code", "__raw",
        native_content.alias("__content"), native_key.alias("__key"),
        _exact_normalized("exact_text", "date_status", "__normalized", "__comparable").alias("__exact"),
    )
    is_exact = F.col("exact_text").isNotNull()
    out = both.select(
        *kept, "date_status", "date_instant", "code",
        F.when(is_exact, F.col("__exact.content")).otherwise(F.col("__content")).alias("content"),
        F.when(is_exact, F.col("__exact.auxiliary_key")).otherwise(F.col("__key")).alias("auxiliary_key"),
        F.coalesce("exact_text", "__raw").alias("raw"),
    ).withColumn("content_sha256", J.content_hash(F.col("content")))
    return computed_once(out)


#: Normalizers by version. A correction gets a new version; a version is never changed in place.
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {NORMALIZER_V1: normalize_v1}


def normalizer(version: str) -> Callable[[DataFrame], DataFrame]:
    if version not in NORMALIZERS:
        raise LookupError(f"movement normalizer {version!r} is not available")
    return NORMALIZERS[version]


def normalize(elements: DataFrame, version: str = NORMALIZER_V1) -> DataFrame:
    return normalizer(version)(elements)


def snapshots(stored_versions: DataFrame, issues: DataFrame, version: str = NORMALIZER_V1) -> DataFrame:
    """One row per version: how many rejections its array had and whether it is complete."""
    normalizer(version)
    rejected = issues.groupBy("version_id").agg(F.count(F.lit(1)).alias("rejection_count"))
    return (
        stored_versions.select(*_KEYS, F.col("first_observed_at").alias("processed_at"))
        .join(rejected, "version_id", "left")
        .select(
            *_KEYS, "processed_at", F.lit(version).alias("normalizer_version"),
            F.coalesce("rejection_count", F.lit(0)).alias("rejection_count"),
            F.col("rejection_count").isNull().alias("is_complete"),
        )
    )


def snapshot_contents(normalized: DataFrame) -> DataFrame:
    """One row per (snapshot, content) with its number of copies."""
    return R.content_counts(
        normalized.withColumn("seen", F.struct(F.col("first_observed_at").alias("at"), "version_id")),
        ["representation_id", "version_id", "content_sha256"],
        ["seen", "auxiliary_key", "code", "date_status", "date_instant"],
    )


def occurrences(contents: DataFrame) -> DataFrame:
    """Ordinal ranges of every content with their first observation over all snapshots."""
    keys = ["representation_id", "content_sha256"]
    ranges = R.occurrence_ranges(contents, keys, "seen")
    facts = contents.groupBy(*keys).agg(
        *[F.min(name).alias(name) for name in ("auxiliary_key", "code", "date_status", "date_instant")]
    )
    return ranges.join(facts, keys).withColumn("first_observed_at", F.col("seen.at"))


def present_associations(contents: DataFrame, occurrence_ranges: DataFrame) -> DataFrame:
    """Every snapshot with the occurrence ranges it holds and their status at that time."""
    keys = ["representation_id", "content_sha256"]
    # The first snapshot in which the auxiliary key was seen with any content.
    group_start = (
        occurrence_ranges.where(F.col("auxiliary_key").isNotNull())
        .groupBy("representation_id", "auxiliary_key")
        .agg(F.min("seen").alias("group_seen"))
    )
    dated = occurrence_ranges.join(group_start, ["representation_id", "auxiliary_key"], "left").select(
        *keys, "auxiliary_key", "group_seen", F.col("seen").alias("first_seen"), "first_ordinal", "last_ordinal",
        "first_observed_at",
    )
    joined = contents.select(*keys, "version_id", "seen", "copies").join(dated, keys).where(
        F.col("first_ordinal") <= F.col("copies")
    )
    fresh = F.col("first_seen") == F.col("seen")
    altered = fresh & (F.col("first_ordinal") == 1) & (F.col("group_seen") < F.col("seen"))
    status = (
        F.when(F.coalesce(altered, F.lit(False)), R.ALTERED).when(fresh, R.FIRST).otherwise(R.KNOWN)
    )
    return joined.select(
        *keys, "version_id", "seen", "auxiliary_key", "first_ordinal",
        F.least("last_ordinal", "copies").alias("last_ordinal"), "first_observed_at", status.alias("status"),
    )


def absent_associations(chosen: DataFrame, contents: DataFrame, occurrence_ranges: DataFrame) -> DataFrame:
    """What earlier snapshots held and the chosen complete snapshots do not.

    ``chosen`` has at most one snapshot per representation, such as the latest complete one.
    """
    keys = ["representation_id", "content_sha256"]
    wanted = chosen.select(
        "representation_id", "version_id", F.struct(F.col("processed_at").alias("at"), "version_id").alias("now")
    )
    held = contents.select(*keys, "version_id", "copies")
    return (
        occurrence_ranges.select(*keys, "seen", "first_ordinal", "last_ordinal")
        .join(wanted, "representation_id")
        .where(F.col("seen") < F.col("now"))
        .join(held, [*keys, "version_id"], "left")
        .where(F.col("last_ordinal") > F.coalesce("copies", F.lit(0)))
        .select(
            *keys, "version_id",
            F.greatest("first_ordinal", F.coalesce("copies", F.lit(0)) + 1).alias("first_ordinal"), "last_ordinal",
            F.lit(R.ABSENT).alias("status"),
        )
    )


def alteration_counts(contents: DataFrame, occurrence_ranges: DataFrame, associations: DataFrame) -> DataFrame:
    """How many earlier and current occurrences each altered group has, and whether it is ambiguous."""
    group = ["representation_id", "auxiliary_key"]
    altered = associations.where(F.col("status") == R.ALTERED).select(*group, "version_id", "seen").distinct()
    first_seen = (
        occurrence_ranges.where(F.col("auxiliary_key").isNotNull())
        .groupBy(*group, "seen")
        .agg(
            F.sum(F.col("last_ordinal") - F.col("first_ordinal") + 1).alias("added"),
            F.min("content_sha256").alias("some_hash"),
        )
    )
    before = Window.partitionBy(*group).orderBy("seen").rowsBetween(Window.unboundedPreceding, -1)
    history = first_seen.select(
        *group, "seen", F.sum("added").over(before).alias("previous_count"),
        F.min("some_hash").over(before).alias("previous_hash"),
    )
    now = contents.groupBy(*group, "version_id").agg(F.sum("copies").alias("current_count"))
    ambiguous = (F.col("previous_count") != 1) | (F.col("current_count") != 1)
    return (
        altered.join(history, [*group, "seen"])
        .join(now, [*group, "version_id"])
        .select(
            *group, "version_id", "previous_count", "current_count", ambiguous.alias("ambiguous"),
            F.when(~ambiguous, F.col("previous_hash")).alias("previous_hash"),
        )
    )


def snapshot_digests(stored_versions: DataFrame, normalized: DataFrame, issues: DataFrame) -> DataFrame:
    """A digest per snapshot over its contents in array order and its issues."""
    parts = R.ordered_digest(normalized, ["version_id"], "position", "content_sha256")
    problems = issues.groupBy("version_id").agg(
        F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("error_path", "validation_code")))), 256).alias("problems")
    )
    return (
        stored_versions.select("representation_id", "version_id")
        .join(parts, "version_id", "left")
        .join(problems, "version_id", "left")
        .select(
            "representation_id", "version_id",
            F.sha2(F.to_json(F.struct(
                F.lit(NORMALIZER_V1).alias("normalizer_version"), F.col("problems").isNull().alias("complete"),
                F.coalesce("digest", F.lit("")).alias("movements"), F.coalesce("problems", F.lit("")).alias("issues"),
            )), 256).alias("result_sha256"),
        )
    )


def timeline(occurrence_ranges: DataFrame, present: DataFrame) -> DataFrame:
    """Movements of the chosen snapshots, one row per occurrence, for a date-ordered list."""
    dated = occurrence_ranges.select(
        "representation_id", "content_sha256", "first_ordinal", "code", "date_status", "date_instant"
    )
    return present.join(dated, ["representation_id", "content_sha256", "first_ordinal"])
