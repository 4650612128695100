"""Hit pages: one JSON envelope per page file, one row per hit.

A page whose envelope breaks the contract fails as a whole; a bad hit inside a sound envelope
stays a row and goes to quarantine later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.functions import jsonvalue as J
from docketflow.operators.steps import computed_once

#: Columns that come with a page, apart from its text.
PAGE_COLUMNS = ["collection_id", "page_revision", "responded_at", "tribunal", "mode"]

#: Pages as newline-delimited records; a folder of them feeds batch and streaming reads alike.
PAGE_SCHEMA = T.StructType(
    [
        T.StructField("collection_id", T.StringType()),
        T.StructField("page_revision", T.LongType()),
        T.StructField("responded_at", T.TimestampType()),
        T.StructField("tribunal", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)

# Nested values are read as text here. That keeps 1 and 1.0 apart and never builds one VARIANT
# of a whole page, which may be larger than a VARIANT can be.
_ENVELOPE = "hits STRUCT<total: STRING, hits: ARRAY<STRING>>"


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Page records from Parquet files."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per raw response file: its name and its whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("payload")
    )


def page_key(collection_id: Column, revision: Column) -> Column:
    """The stable name of a page: the same collection and revision give the same name again."""
    identity = J.json_object(
        ("collection_id", J.quoted(collection_id.cast("string"))),
        ("previous_checkpoint_revision", revision.cast("string")),
    )
    return J.content_hash(identity)


def with_envelope(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Add the total, the hit texts and the envelope error (NULL for a sound envelope)."""
    read = pages.withColumn("__envelope", F.from_json(F.col(payload), _ENVELOPE))
    hits = F.col("__envelope.hits.hits")
    total = F.try_parse_json(F.col("__envelope.hits.total"))
    total_error = _total_error(F.col("__envelope.hits.total"), total)
    # A text that stands where a hit should be reads like the hit's own text, so the kinds are taken from the page itself.
    quoted = F.exists(F.from_json(F.col(payload), "hits STRUCT<hits: ARRAY<VARIANT>>")["hits"]["hits"], J.is_text)
    error = (
        F.when(~F.coalesce(F.ltrim(F.col(payload)).startswith("{"), F.lit(False)), "ENVELOPE_NOT_OBJECT")
        .when(F.col("__envelope.hits").isNull(), "HITS_NOT_OBJECT")
        .when(hits.isNull(), "HITS_NOT_ARRAY")
        .when(F.exists(hits, lambda hit: ~_sound_hit(hit)) | F.coalesce(quoted, F.lit(False)), "HIT_NOT_SOUND")
        .otherwise(total_error)
    )
    value, relation = total_parts(total)
    out = read.select(
        *pages.columns,
        hits.alias("hit_texts"),
        value.alias("total_value"),
        relation.alias("total_relation"),
        total_kind(value, relation).alias("total_kind"),
        error.alias("page_error"),
    )
    return computed_once(out)


def _sound_hit(hit: Column) -> Column:
    """An object with a non-empty list of scalar sort values."""
    sort = J.get(F.try_parse_json(hit), "$.sort", "array<variant>")
    scalar = F.forall(sort, lambda item: ~F.to_json(item).rlike(r"^[\[{]"))
    return F.coalesce(hit.startswith("{") & (F.size(sort) > 0) & scalar, F.lit(False))


def _total_error(text: Column, total: Column) -> Column:
    kind = J.type_name(total)
    value, relation = J.get(total, "$.value"), J.get(total, "$.relation")
    value_kind, relation_kind = J.type_name(value), J.type_name(relation)
    bad_value = (value_kind.isNotNull() & ~value_kind.isin("null", "integer")) | (
        J.get(total, "$.value", "long") < 0
    )
    bad_relation = relation_kind.isNotNull() & ~(
        (relation_kind == "null")
        | ((relation_kind == "string") & (F.trim(J.get(total, "$.relation", "string")) != ""))
    )
    bad_object = (kind == "object") & (
        F.coalesce(bad_value, F.lit(False)) | F.coalesce(bad_relation, F.lit(False))
    )
    bad = (
        (text.isNotNull() & total.isNull())
        | ~kind.isin("null", "integer", "object")
        | ((kind == "integer") & (J.get(total, "$", "long") < 0))
        | bad_object
    )
    return F.when(F.coalesce(bad, F.lit(False)), "TOTAL_INVALID")


def total_parts(total: Column) -> tuple[Column, Column]:
    """Value and relation of an integer total or of a total object."""
    kind = J.type_name(total)
    value = F.when(kind == "integer", J.get(total, "$", "long")).when(
        kind == "object", J.get(total, "$.value", "long")
    )
    relation = F.when(kind == "object", J.text_at(total, "$.relation"))
    return value, relation


def total_kind(value: Column, relation: Column) -> Column:
    """exact, lower_bound or unknown. A lower bound is never a basis for a percentage."""
    return (
        F.when(value.isNull(), "unknown")
        .when(relation == "gte", "lower_bound")
        .when(relation.isNull() | (relation == "eq"), "exact")
        .otherwise("unknown")
    )


def page_errors(enveloped: DataFrame) -> DataFrame:
    """Pages that fail as a whole."""
    return enveloped.where(F.col("page_error").isNotNull()).drop("hit_texts")


def require_sound(enveloped: DataFrame) -> DataFrame:
    """The same pages; a job that reads a page with an envelope error fails."""
    checked = F.assert_true(
        F.col("page_error").isNull(), F.concat(F.lit("page contract broken: "), F.col("page_error"))
    )
    return enveloped.where(checked.isNull())


def explode_hits(enveloped: DataFrame) -> DataFrame:
    """One row per hit of a sound page, with its one-based position."""
    sound = enveloped.where(F.col("page_error").isNull())
    kept = [name for name in PAGE_COLUMNS if name in enveloped.columns]
    return sound.select(
        *kept,
        page_key(F.col("collection_id"), F.col("page_revision")).alias("page_key"),
        F.posexplode("hit_texts").alias("__position", "hit"),
    ).withColumn("hit_ordinal", F.col("__position") + 1).drop("__position")


def scan_pages(pages: DataFrame) -> DataFrame:
    """Hits of all sound pages."""
    return explode_hits(with_envelope(pages))
