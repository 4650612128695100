"""Movement arrays compared as multisets with the retained history of their representation.

An occurrence is (representation, content hash, ordinal). Equal contents get the ordinals 1..n, so
how often a content occurs says everything about its ordinals. All comparisons below therefore
work on one row per (representation, hash) with a count: a group of equal copies is one row after
the partial aggregation, however many copies there are. Ordinals appear as closed ranges and are
only spelled out by ``expand_ranges``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.operators.steps import computed_once

KNOWN = "KNOWN"
FIRST = "FIRST_OBSERVED"
ALTERED = "ALTERATION_OBSERVED"
ABSENT = "NOT_PRESENT_IN_SNAPSHOT"


def content_counts(rows: DataFrame, keys: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """One row per content with its number of copies.

    ``carried`` columns are functions of the content, such as its auxiliary key.
    """
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), *[F.min(name).alias(name) for name in carried]
    )


def raw_evidence(rows: DataFrame, keys: Sequence[str], raw: str) -> DataFrame:
    """Ordinal ranges of each distinct raw text inside its content, ordered by raw text.

    The array position plays no part. Equal raw texts share one row.
    """
    texts = rows.groupBy(*keys, raw).agg(F.count(F.lit(1)).alias("copies"))
    upto = Window.partitionBy(*keys).orderBy(raw).rowsBetween(Window.unboundedPreceding, 0)
    return texts.withColumn("last_ordinal", F.sum("copies").over(upto)).withColumn(
        "first_ordinal", F.col("last_ordinal") - F.col("copies") + 1
    )


def expand_ranges(ranges: DataFrame, first: str = "first_ordinal", last: str = "last_ordinal",
                  name: str = "ordinal", chunk: int = 10_000) -> DataFrame:
    """One row per ordinal. A long range is cut into chunks that spread over the tasks first.

    Ranges of one chunk are spelled out where they are, so only the long ones are dealt anew.
    """
    ranges = computed_once(ranges)
    ends = F.col(first).cast("long"), F.col(last).cast("long")
    is_long = F.coalesce(ends[1] - ends[0] >= chunk, F.lit(False))
    short = ranges.where(~is_long).withColumn(name, F.explode(F.sequence(*ends, F.lit(1).cast("long"))))
    chunks = ranges.where(is_long).withColumn("__start", F.explode(F.sequence(*ends, F.lit(chunk).cast("long"))))
    spread = chunks.repartition(*[F.col(c) for c in ranges.columns[:2]], F.col("__start"))
    stop = F.least(F.col("__start") + (chunk - 1), ends[1])
    long = spread.withColumn(name, F.explode(F.sequence(F.col("__start"), stop)))
    return short.drop(first, last).unionByName(long.drop("__start", first, last))


def hash_collisions(rows: DataFrame, hash_column: str, content: str) -> DataFrame:
    """Hashes that stand for more than one content."""
    return (
        rows.groupBy(hash_column)
        .agg(F.min(content).alias("__low"), F.max(content).alias("__high"))
        .where(F.col("__low") != F.col("__high"))
        .select(hash_column)
    )


def require_no_collisions(rows: DataFrame, hash_column: str, content: str) -> None:
    """Fail when one hash stands for two contents."""
    if not hash_collisions(rows, hash_column, content).isEmpty():
        raise ValueError("one content hash stands for different contents")


def alteration_groups(
    current: DataFrame, history: DataFrame, owner: str, hash_column: str, auxiliary: str
) -> DataFrame:
    """Auxiliary keys under which a new content appeared beside older, different contents.

    ``current`` and ``history`` hold one row per (owner, hash) with ``copies`` and the auxiliary
    key. One row comes out per (owner, auxiliary key): how many occurrences stand on each side,
    whether the match is ambiguous, and the single previous hash when it is not. Members are
    looked up by the group key, so no pairs of contents are ever formed.
    """
    old = history.where(F.col(auxiliary).isNotNull()).select(
        owner, auxiliary, hash_column, F.lit(0).alias("now"), F.col("copies").alias("before")
    )
    new = current.where(F.col(auxiliary).isNotNull()).select(
        owner, auxiliary, hash_column, F.col("copies").alias("now"), F.lit(0).alias("before")
    )
    contents = (
        old.unionByName(new)
        .groupBy(owner, auxiliary, hash_column)
        .agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
    )
    is_now, was_before = F.col("now") > 0, F.col("before") > 0
    grouped = contents.groupBy(owner, auxiliary).agg(
        F.sum("now").alias("current_count"),
        F.sum("before").alias("previous_count"),
        F.count_if(was_before).alias("previous_contents"),
        F.count_if(is_now & ~was_before).alias("new_contents"),
        F.min(F.when(was_before, F.col(hash_column))).alias("__previous_hash"),
    )
    # With one current content it is the new one, and with more than one each older content
    # differs from some current one: either way every older occurrence is a candidate.
    found = grouped.where((F.col("new_contents") > 0) & (F.col("previous_contents") > 0))
    ambiguous = (F.col("previous_count") != 1) | (F.col("current_count") != 1)
    return found.select(
        owner,
        auxiliary,
        "previous_count",
        "current_count",
        ambiguous.alias("ambiguous"),
        F.when(~ambiguous, F.col("__previous_hash")).alias("previous_hash"),
    )


def reconcile(
    current: DataFrame,
    history: DataFrame,
    owner: str,
    hash_column: str,
    auxiliary: str | None = None,
    complete: DataFrame | None = None,
) -> DataFrame:
    """Compare one snapshot per owner with that owner's history.

    Both sides hold one row per (owner, hash) with ``copies``; the history's count is the highest
    ordinal ever seen. Returns ordinal ranges with their status. Owners listed in ``complete``
    (all of ``current``'s owners when omitted) also report what is no longer there; an incomplete
    snapshot never claims that something disappeared.
    """
    keys = [owner, hash_column]
    side = current.select(*keys, F.col("copies").alias("now"))
    past = history.select(*keys, F.col("copies").alias("before"))
    both = side.join(past, keys, "full_outer").select(
        *keys, F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("before", F.lit(0)).alias("before")
    )
    if auxiliary is not None:
        groups = alteration_groups(current, history, owner, hash_column, auxiliary)
        altered = (
            current.select(*keys, auxiliary)
            .join(groups.select(owner, auxiliary), [owner, auxiliary], "left_semi")
            .select(*keys, F.lit(True).alias("__grouped"))
        )
        both = both.join(altered, keys, "left")
        # A content seen before is never an alteration; its extra copies are new occurrences.
        fresh = F.when(F.col("__grouped") & (F.col("before") == 0), ALTERED).otherwise(FIRST)
    else:
        fresh = F.lit(FIRST)
    ranges = F.array(
        F.struct(F.lit(KNOWN).alias("status"), F.lit(1).cast("long").alias("first_ordinal"),
                 F.least("now", "before").alias("last_ordinal")),
        F.struct(fresh.alias("status"), (F.col("before") + 1).alias("first_ordinal"),
                 F.col("now").alias("last_ordinal")),
        F.struct(F.lit(ABSENT).alias("status"), (F.col("now") + 1).alias("first_ordinal"),
                 F.col("before").alias("last_ordinal")),
    )
    out = both.select(*keys, F.inline(ranges)).where(F.col("first_ordinal") <= F.col("last_ordinal"))
    claims = (current if complete is None else complete).select(owner).distinct().withColumn(
        "__complete", F.lit(True)
    )
    absent = F.col("status") == ABSENT
    return (
        out.join(claims, owner, "left")
        .where(~absent | F.coalesce("__complete", F.lit(False)))
        .drop("__complete")
    )


def updated_history(current: DataFrame, history: DataFrame, keys: Sequence[str],
                    carried: Sequence[str] = ()) -> DataFrame:
    """The history after a snapshot: absent occurrences stay, new ones are added."""
    columns = [*keys, "copies", *carried]
    return (
        history.select(*columns)
        .unionByName(current.select(*columns))
        .groupBy(*keys)
        .agg(F.max("copies").alias("copies"), *[F.min(name).alias(name) for name in carried])
    )


def occurrence_ranges(counts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First observation of every ordinal over all snapshots of a representation.

    ``counts`` holds one row per (keys, snapshot) with ``copies`` and the snapshot's ``order``
    value. Ordinals that were first seen together form one range.
    """
    # An ordinal n is first seen in the earliest snapshot with at least n copies.
    steps = counts.groupBy(*keys, "copies").agg(F.min(order).alias(order))
    fewer = Window.partitionBy(*keys).orderBy(F.col("copies").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    reached = steps.withColumn(order, F.min(order).over(fewer))
    ladder = reached.groupBy(*keys, order).agg(F.max("copies").alias("last_ordinal"))
    below = Window.partitionBy(*keys).orderBy("last_ordinal")
    return ladder.withColumn(
        "first_ordinal", F.coalesce(F.lag("last_ordinal").over(below), F.lit(0)) + 1
    )


def ordered_digest(rows: DataFrame, keys: Sequence[str], position: str, content: str) -> DataFrame:
    """A digest per key that depends on the order of its parts.

    Parts are hashed in runs of 1000 positions and the run digests are hashed again, so the parts
    of a very long array never meet in one task.
    """
    runs = rows.withColumn("__run", F.floor(F.col(position) / 1000)).groupBy(*keys, "__run").agg(
        F.sha2(
            F.to_json(F.transform(
                F.array_sort(F.collect_list(F.struct(position, content))), lambda item: item[content]
            )),
            256,
        ).alias("__digest")
    )
    return runs.groupBy(*keys).agg(
        F.sha2(
            F.to_json(F.transform(
                F.array_sort(F.collect_list(F.struct("__run", "__digest"))), lambda item: item["__digest"]
            )),
            256,
        ).alias("digest")
    )
