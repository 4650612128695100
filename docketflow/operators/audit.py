"""Source audits: samples, field shapes, evidence matrices, attempts and run profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.functions import jsonvalue as J

VALIDATED, INCOMPATIBLE, INCONCLUSIVE, NOT_RUN = "VALIDATED", "INCOMPATIBLE", "INCONCLUSIVE", "NOT_RUN"
NOT_APPLICABLE, APPLICABLE = "NOT_APPLICABLE", "APPLICABLE"

#: Distinct matching documents that make a sample sufficient.
MIN_DISTINCT_DOCUMENTS = 3


def sample_validation(hits: DataFrame, requested: DataFrame, item: str = "item_id") -> DataFrame:
    """Query and sample state per item: does every hit carry a requested code in each dimension.

    ``hits``: item, hit_id, document_id, dimension, code — one row per code a hit carries, and a
    row with NULL dimension for a hit without codes. ``requested``: item, dimension, code.
    """
    wanted = requested.select(item, "dimension", "code").distinct()
    needed = wanted.groupBy(item).agg(F.count_distinct("dimension").alias("needed"))
    found = hits.join(wanted, [item, "dimension", "code"])
    met = found.groupBy(item, "hit_id").agg(F.count_distinct("dimension").alias("met"))
    each = (
        hits.groupBy(item, "hit_id")
        .agg(F.min("document_id").alias("document_id"))
        .join(met, [item, "hit_id"], "left")
        .join(needed, item, "left")
    )
    matches = F.coalesce("met", F.lit(0)) == F.coalesce("needed", F.lit(0))
    counted = each.groupBy(item).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(matches).alias("matching_hits"),
        F.count_if(~matches).alias("mismatched_hits"),
        F.count_distinct(F.when(matches, F.col("document_id"))).alias("distinct_documents"),
    )
    listed = requested.select(item).distinct().join(counted, item, "left")
    bad, none = F.col("mismatched_hits") > 0, F.col("sample_count").isNull()
    return listed.select(
        item,
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("sample_count", "matching_hits", "mismatched_hits", "distinct_documents")],
        F.when(none, INCONCLUSIVE).when(bad, INCOMPATIBLE).otherwise(VALIDATED).alias("query_state"),
        F.when(none, INCONCLUSIVE)
        .when(bad, INCOMPATIBLE)
        .when(F.col("distinct_documents") >= MIN_DISTINCT_DOCUMENTS, VALIDATED)
        .otherwise(INCONCLUSIVE)
        .alias("sample_state"),
    )


def matched_code_counts(hits: DataFrame, requested: DataFrame, item: str = "item_id") -> DataFrame:
    """How many hits carry each requested code."""
    wanted = requested.select(item, "dimension", "code").distinct()
    return hits.join(wanted, [item, "dimension", "code"]).groupBy(item, "dimension", "code").agg(
        F.count_distinct("hit_id").alias("hits")
    )


def field_shapes(sources: DataFrame, value: Column, paths: Sequence[str]) -> DataFrame:
    """How often each path is present and which JSON types it takes.

    All paths are read in one pass; per path and type one small counter row is left.
    """
    opened = sources.select(value.alias("__value"))
    stacked = opened.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(p).alias("path"), J.type_name(J.get(F.col("__value"), f"$.{p}")).alias("type"))
                for p in paths
            ])
        ).alias("s")
    ).select("s.path", "s.type")
    per_type = stacked.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))
    return per_type.groupBy("path").agg(
        F.coalesce(F.sum(F.when(F.col("type").isNotNull(), F.col("n"))), F.lit(0)).alias("present_count"),
        F.sum("n").alias("sample_count"),
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
    )


def quality_assessment(hits: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Essential fields, tribunal, date range and identity of each sample, and the states they give.

    ``hits``: key, process_number, filed_on, source_id, hit_id, tribunal. ``groups``: key,
    expected_tribunal, filed_from, filed_to. A sample without hits proves nothing.
    """

    def filled(name: str) -> Column:
        return F.coalesce(F.trim(name) != "", F.lit(False))

    number = F.coalesce(F.col("process_number").rlike("^[0-9]{20}$"), F.lit(False))
    day = F.col("filed_on")
    joined = hits.join(groups, key)
    in_range = F.coalesce((day >= F.col("filed_from")) & (day < F.col("filed_to")), F.lit(False))
    counted = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(number & day.isNotNull() & filled("source_id") & filled("hit_id")).alias("essential_valid"),
        F.count_if(F.coalesce(F.col("tribunal") == F.col("expected_tribunal"), F.lit(False))).alias("tribunal_valid"),
        F.count_if(in_range).alias("date_valid"),
        F.count_if(filled("hit_id") & F.coalesce(F.col("hit_id") == F.col("source_id"), F.lit(False))).alias("identity_valid"),
        F.min("filed_on").alias("min_date"),
        F.max("filed_on").alias("max_date"),
    )
    full = groups.select(key).join(counted, key, "left")

    def state(name: str) -> Column:
        return (
            F.when(F.col("sample_count").isNull(), INCONCLUSIVE)
            .when(F.col(name) == F.col("sample_count"), VALIDATED)
            .otherwise(INCOMPATIBLE)
        )

    return full.select(
        key, F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        state("essential_valid").alias("essential_fields"), state("tribunal_valid").alias("tribunal_identity"),
        state("date_valid").alias("date_filter"), state("identity_valid").alias("source_identity"),
        "min_date", "max_date",
    )


def _has(state: str) -> Column:
    return F.count_if(F.col("state") == state) > 0


def rolled_up_state(allow_not_applicable: bool = False) -> Column:
    """An aggregate over ``state``: the strongest statement the evidence allows."""
    inapplicable = F.count_if(F.col("state") == NOT_APPLICABLE)
    alone = inapplicable == F.count("state")
    return (
        F.when(F.count("state") == 0, NOT_RUN)
        .when(_has(INCOMPATIBLE), INCOMPATIBLE)
        .when((inapplicable > 0) & alone & F.lit(allow_not_applicable), NOT_APPLICABLE)
        .when(inapplicable > 0, INCOMPATIBLE)
        .when(_has(VALIDATED), VALIDATED)
        .when(_has(INCONCLUSIVE), INCONCLUSIVE)
        .otherwise(NOT_RUN)
    )


def evidence_grid(rows: DataFrame, key: str, columns: Sequence[str], column_name: str) -> DataFrame:
    """Every row key with every column name; the names are a short fixed list."""
    return rows.select(key, F.explode(F.array(*[F.lit(name) for name in columns])).alias(column_name))


def capability_cells(grid: DataFrame, attempts: DataFrame, resolutions: DataFrame, key: str, column: str,
                     allow_not_applicable: bool = False) -> DataFrame:
    """One cell per grid position: attempts rolled up, a reviewed resolution overriding them."""
    cells = attempts.groupBy(key, column).agg(
        rolled_up_state(allow_not_applicable).alias("rolled"), F.count(F.lit(1)).alias("attempt_count")
    )
    reviewed = resolutions.select(key, column, F.lit(True).alias("resolved")).distinct()
    return (
        grid.join(cells, [key, column], "left")
        .join(reviewed, [key, column], "left")
        .select(
            key, column,
            F.when(F.col("resolved"), VALIDATED).otherwise(F.coalesce("rolled", F.lit(NOT_RUN))).alias("state"),
            F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"),
            F.coalesce("resolved", F.lit(False)).alias("resolved"),
        )
    )


def row_states(cells: DataFrame, key: str) -> DataFrame:
    """The state of a whole row of cells."""
    every = lambda name: F.count_if(F.col("state") != name) == 0
    state = (
        F.when(_has(INCOMPATIBLE), INCOMPATIBLE)
        .when(every(VALIDATED), VALIDATED)
        .when(every(NOT_RUN), NOT_RUN)
        .otherwise(INCONCLUSIVE)
    )
    return cells.groupBy(key).agg(state.alias("row_state"), F.count(F.lit(1)).alias("cells"))


def stale_reasons(current: dict[str, Column]) -> Column:
    """Why a pair attempt no longer counts, as an array. ``current`` holds the present versions."""
    reviewed = F.col("applicability_state").isin(APPLICABLE, NOT_APPLICABLE)

    def differs(name: str) -> Column:
        return ~F.col(name).eqNullSafe(current[name])

    return F.array_compact(
        F.array(
            F.when(differs("catalog_version"), "CATALOG_VERSION_CHANGED"),
            F.when(differs("preset_version"), "PRESET_VERSION_CHANGED"),
            F.when(reviewed & differs("tpu_version"), "TPU_VERSION_CHANGED"),
        )
    )


def applicability_consensus(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The one applicability all current attempts agree on, else INCONCLUSIVE."""
    value = F.col("applicability_state")
    return attempts.groupBy(*keys).agg(
        F.when(F.min(value) == F.max(value), F.min(value)).otherwise(INCONCLUSIVE).alias("applicability")
    )


def pair_state(applicability: Column, query: Column, sample: Column) -> Column:
    """One state from applicability, query state and sample state."""
    either = lambda name: (query == name) | (sample == name)
    return (
        F.when(applicability == NOT_APPLICABLE, NOT_APPLICABLE)
        .when(F.coalesce(applicability != APPLICABLE, F.lit(True)), INCONCLUSIVE)
        .when(either(INCOMPATIBLE), INCOMPATIBLE)
        .when((query == VALIDATED) & (sample == VALIDATED), VALIDATED)
        .when(either(NOT_RUN), NOT_RUN)
        .otherwise(INCONCLUSIVE)
    )


def is_complete(capabilities: DataFrame, pairs: DataFrame, expected_rows: int, expected_capabilities: int,
                expected_pairs: int, key: str) -> DataFrame:
    """Whether every capability is validated and every pair validated or not applicable."""
    sound_capability = F.col("state") == VALIDATED
    sound_pair = F.col("state").isin(VALIDATED, NOT_APPLICABLE)

    def summary(cells: DataFrame, sound: Column, prefix: str) -> DataFrame:
        return cells.agg(
            F.count_distinct(key).alias(f"{prefix}_rows"), F.count(F.lit(1)).alias(f"{prefix}_cells"),
            F.coalesce(F.bool_and(sound), F.lit(False)).alias(f"{prefix}_sound"), F.lit(1).alias("__one"),
        )

    both = summary(capabilities, sound_capability, "c").join(summary(pairs, sound_pair, "p"), "__one")
    whole = (
        (F.col("c_rows") == expected_rows) & (F.col("p_rows") == expected_rows)
        & (F.col("c_cells") == expected_rows * expected_capabilities)
        & (F.col("p_cells") == expected_rows * expected_pairs)
    )
    return both.select((whole & F.col("c_sound") & F.col("p_sound")).alias("complete"))


def deduplicated_attempts(attempts: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """One row per attempt with how often it was reported and whether its reports diverge."""
    return attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reports"),
        F.min(digest).alias("digest"),
        (F.min(digest) != F.max(digest)).alias("divergent"),
    )


def request_total_mismatches(declared: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Batches whose declared request total differs from the sum of their parts."""
    sums = observed.groupBy(key).agg(F.sum("requests").alias("observed"))
    return declared.select(key, F.col("requests").alias("declared")).join(sums, key, "left").withColumn(
        "observed", F.coalesce("observed", F.lit(0))
    ).where(F.col("declared") != F.col("observed"))


def batch_exceptions(reports: DataFrame, requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reports with failed requests, pairs that were not run, or an early stop.

    ``reports``: run_id, alias, stop_reason. The lists of one report are short.
    """
    keys = ["run_id", "alias"]
    failed = requests.where(F.col("outcome") == "ERROR").groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("preset_id").isNull(), F.col("name")))), ",").alias("failed_requests"),
        F.array_join(
            F.array_sort(F.collect_list(F.concat("preset_id", F.lit(":"), "name"))), ","
        ).alias("failed_pair_requests"),
    )
    skipped = pairs.where(F.col("pair_state") == NOT_RUN).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("preset_id")), ",").alias("pairs_not_run")
    )
    joined = reports.select(*keys, "stop_reason").join(failed, keys, "left").join(skipped, keys, "left")
    return joined.where(
        F.col("failed_requests").isNotNull() | F.col("pairs_not_run").isNotNull() | F.col("stop_reason").isNotNull()
    )


def lower_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact percentiles at the lower index int((n-1)*p), per key.

    Values are counted first. The counts of ``RANGES`` equal ranges between a key's ends tell in which range each
    rank lies, and only that range is counted through, again in ranges of its own. No group is ever collected, so a key may hold any
    number of rows, and values that lie close together are told apart wherever they lie.
    """
    from docketflow.operators.ordered import running_totals

    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.sum("n").alias("__total"))
    placed = counts.join(ends, keys).withColumn("__range", _range_of(F.col(value), F.col("__low"), F.col("__high")))
    rows = placed.groupBy(*keys, "__range").agg(F.sum("n").alias("__n"), F.first("__total").alias("__total"), F.min(value).alias("__from"), F.max(value).alias("__to"))
    # At most RANGES rows for a key.
    upto = rows.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range")))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), (F.floor((F.col("__total") - 1) * F.lit(p)) + 1).alias("rank")) for n, p in fractions.items()])
    held = upto.withColumn("__wanted", F.explode(wanted)).where("__wanted.rank <= __upto AND __wanted.rank > __upto - __n").select(
        *keys, "__range", "__from", "__to", F.col("__wanted.name").alias("__name"), (F.col("__wanted.rank") - F.col("__upto") + F.col("__n")).alias("__rank"))
    inside = placed.select(*keys, value, "n", "__range").join(held, [*keys, "__range"])
    counted = running_totals(inside, [*keys, "__name"], [value], _range_of(F.col(value), F.col("__from"), F.col("__to")), {"__upto": F.col("n")})

    def at(name: str) -> Column:
        return F.min(F.when((F.col("__name") == name) & (F.col("__upto") >= F.col("__rank")), F.col(value))).alias(name)

    return counted.groupBy(*keys).agg(*[at(name) for name in fractions])


#: Ranges that a key's values are counted in.
RANGES = 1024


def _range_of(value: Column, low: Column, high: Column) -> Column:
    """The number of the equal range between two ends that holds a value; it never falls where the value rises."""
    share = (value.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
    return F.when(high > low, F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0)).cast("long")


def run_profiles(runs: DataFrame, repetitions: int, profile: str = "page_size") -> DataFrame:
    """Mean throughput per profile and whether all its runs kept the integrity rules."""
    enough = F.count(F.lit(1)) == repetitions
    return runs.groupBy(profile).agg(
        F.count(F.lit(1)).alias("runs"),
        F.when(enough, F.avg("hits_per_minute")).alias("mean_hits_per_minute"),
        F.when(~enough, INCONCLUSIVE).when(F.bool_and("sound"), "PASS").otherwise("FAIL").alias("integrity"),
    )


def best_profile(profiles: DataFrame, profile: str = "page_size") -> DataFrame:
    """The sound profile with the highest mean; the smaller one at a tie."""
    sound = profiles.where(F.col("integrity") == "PASS")
    order = F.struct(F.col("mean_hits_per_minute"), F.negative(F.col(profile)))
    return sound.agg(F.max_by(profile, order).alias("selected_profile"))
