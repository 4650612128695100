"""What plans leave out and where rows are dealt anew; each of these failed before the plans were made for larger tables."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketflow.functions import dates as D
from docketflow.operators import ordered as O
from docketflow.operators import reconcile as R
from docketflow.operators.steps import computed_once
from docketflow.plans import ingest

DAY = dt.datetime(2026, 10, 1, 12)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def hits(spark, sources):
    rows = [("c", 1, "p", n, DAY, "TJGO", "demo", json.dumps({"_id": s.get("id"), "_source": s})) for n, s in enumerate(sources)]
    return spark.createDataFrame(
        rows, "collection_id string, page_revision long, page_key string, hit_ordinal int, responded_at timestamp, tribunal string, mode string, hit string"
    )


def source(ident, **fields):
    return {"id": ident, "numeroProcesso": "00000010020268090001", "tribunal": "TJGO", **fields}


def test_unread_columns_are_not_computed(spark):
    rows = spark.range(5).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hash"), (F.col("id") * 2).alias("twice"))
    kept = computed_once(rows).where("twice > 2")
    assert "sha2" not in optimized(kept.select("id"))
    assert "sha2" in optimized(kept.select("hash"))
    assert sorted(r.id for r in kept.select("id").collect()) == [2, 3, 4]
    # The filter stays above the boundary, so the product stands in the plan once.
    assert optimized(kept.select("twice")).count("* 2") == 1


def test_rejections_need_no_payload(spark):
    prepared = ingest.prepare_hits(hits(spark, [source("a"), source("b", numeroProcesso="1"), {"id": None}]))
    rejected = ingest.cover_rejections(prepared).select("hit_ordinal", "validation_code")
    assert "sha2" not in optimized(rejected) and "pythonUDF" not in optimized(rejected)
    assert {tuple(r) for r in rejected.collect()} == {(1, "CNJ_INVALID"), (2, "SOURCE_ID_INVALID")}
    assert {r.hit_ordinal: r.payload is None for r in prepared.collect()} == {0: False, 1: True, 2: True}


def test_versions_and_projection_take_the_columns_given(spark):
    valid = ingest.valid_hits(ingest.prepare_hits(hits(spark, [source("a", grau="G1"), source("a", grau="G2"), source("a", grau="G1")])))
    narrow = valid.select(*ingest.VERSION_KEYS, "grau", *ingest.OBSERVATION_ORDER)
    kept = ingest.versions(narrow)
    assert set(kept.columns) == {*ingest.VERSION_KEYS, "grau", "first_observed_at"}
    whole = ingest.versions(valid)
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in whole.select(*kept.columns).collect()}
    last = ingest.representations(ingest.observations(valid), kept)
    assert [r.grau for r in last.collect()] == ["G1"]


def test_only_keys_with_many_rows_are_cut(spark, monkeypatch):
    rows = spark.range(200).select(
        F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        F.col("id").alias("n"), (F.col("id") % 7).alias("value"),
    )
    window = Window.partitionBy("key").orderBy("n")
    wanted = {tuple(r) for r in rows.select("key", "n", F.lag("value").over(window)).collect()}
    for most in (0, 30, 100_000):
        monkeypatch.setattr(O, "WHOLE", most)
        cut = {r.key for r in O._bucketed(rows, ["key"], O.number_bucket(F.col("n"), 9), F.lit(None).cast("long")).where("__bucket IS NOT NULL").select("key").collect()}
        assert ("hot" in cut) == (most <= 30) and ("k1" in cut) == (most == 0)
        got = O.previous_values(rows, ["key"], ["n"], O.number_bucket(F.col("n"), 9), ["value"]).select("key", "n", "prev_value")
        assert {tuple(r) for r in got.collect()} == wanted


def test_rows_without_a_bucket_end_where_they_did(spark, monkeypatch):
    """The row after one without an order value is not its neighbour; the other way round it is."""
    rows = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 30, 3)], "key string, n long, value int")
    for most in (0, 100_000):
        monkeypatch.setattr(O, "WHOLE", most)
        after = O.next_values(rows, ["key"], ["n"], O.number_bucket(F.col("n"), 10), ["value"])
        before = O.previous_values(rows, ["key"], ["n"], O.number_bucket(F.col("n"), 10), ["value"])
        assert {r.value: r.next_value for r in after.collect()} == {1: None, 2: 3, 3: None}
        assert {r.value: r.prev_value for r in before.collect()} == {1: None, 2: 1, 3: 2}


def test_short_ranges_are_spelled_out_in_place(spark):
    ranges = spark.createDataFrame([("a", 1, 3), ("b", 2, 7), ("c", 4, 4)], "k string, first_ordinal long, last_ordinal long").withColumn("h", F.lit("x"))
    out = R.expand_ranges(ranges.select("k", "h", "first_ordinal", "last_ordinal"), chunk=4)
    assert sorted((r.k, r.ordinal) for r in out.collect()) == [
        *[("a", n) for n in (1, 2, 3)], *[("b", n) for n in range(2, 8)], ("c", 4)]
    short, long = optimized(out).split("RepartitionByExpression")
    assert "Union" in short and "explode(sequence(" in short


def test_equal_dates_are_not_parsed_and_plain_ones_stay(spark):
    texts = ["20200102030405", "2020-01-02T03:04:05Z", "2020-01-02T03:04:05-0300", "2020-01-02 03:04", "2020-01-02T03:04:05,5+03", "x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.readable(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [
        "2020-01-02 03:04:05", "2020-01-02 03:04:05Z", "2020-01-02 03:04:05-03:00", "2020-01-02 03:04:00", "2020-01-02 03:04:05.5+03:00", None, None]
    pairs = spark.createDataFrame([("20200102000000", "20200101000000"), ("20200101000000", "20200101000000"), (None, "20200101000000")], "a string, b string")
    assert [r.w for r in pairs.select(D.regressed(F.col("a"), F.col("b")).alias("w")).collect()] == [True, False, False]
