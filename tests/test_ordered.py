"""Bucketed ordered work equals plain windows, also where one key holds most rows."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from docketflow.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(7))
    return spark.range(6000).select(
        key.alias("key"), F.col("id").alias("n"), (F.hash("id") % 5).alias("value"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 17).alias("at"),
    )


def same(left, right):
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("width", [1, 37, 100_000])
def test_neighbours(skewed, width):
    window = Window.partitionBy("key").orderBy("n")
    bucket = O.number_bucket(F.col("n"), width)
    got = O.previous_values(skewed, ["key"], ["n"], bucket, ["value"]).select("key", "n", "prev_value", "prev_exists")
    same(got, skewed.select("key", "n", F.lag("value").over(window), F.lag("n").over(window).isNotNull()))
    got = O.next_values(skewed, ["key"], ["n"], bucket, ["value"]).select("key", "n", "next_value")
    same(got, skewed.select("key", "n", F.lead("value").over(window)))


@pytest.mark.parametrize("width", [1, 53, 100_000])
def test_running(skewed, width):
    window = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    bucket = O.number_bucket(F.col("n"), width)
    got = O.running_totals(skewed, ["key"], ["n"], bucket, {"total": F.col("value"), "row": F.lit(1)}).select("key", "n", "total", "row")
    same(got, skewed.select("key", "n", F.sum("value").over(window), F.count("n").over(window)))
    got = O.running_maxima(skewed, ["key"], ["n"], bucket, {"top": F.col("value")}).select("key", "n", "top")
    same(got, skewed.select("key", "n", F.max("value").over(window)))


def test_latest_and_earliest(skewed):
    last = {(r.key, r.n) for r in O.latest(skewed, ["key"], ["n"]).collect()}
    first = {(r.key, r.n) for r in O.earliest(skewed, ["key"], ["n"]).collect()}
    assert last == {tuple(r) for r in skewed.groupBy("key").agg(F.max("n")).collect()}
    assert first == {tuple(r) for r in skewed.groupBy("key").agg(F.min("n")).collect()}


def test_quota_boundary(spark):
    """The 121st start violates the quota at 59.999 s and keeps it at 60 s."""
    from docketflow.operators.collection import quota_audit

    for last, broken in ((59_999, True), (60_000, False)):
        millis = [i * 495 for i in range(120)] + [last]
        rows = spark.createDataFrame([("s", i, m) for i, m in enumerate(millis)], "source string, n int, ms long")
        starts = rows.select("source", "n", F.timestamp_millis("ms").alias("at"))
        audited = quota_audit(starts, ["source"], "at", ["at", "n"])
        assert audited.where("n = 120").first().over_quota is broken
        assert audited.where("too_close").count() >= 119


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(0, 3)), min_size=1, max_size=40, unique_by=lambda t: t[:2]))
def test_neighbours_property(spark, rows):
    df = spark.createDataFrame(rows, "key int, n int, value int")
    window = Window.partitionBy("key").orderBy("n")
    got = O.previous_values(df, ["key"], ["n"], O.number_bucket(F.col("n"), 5), ["value"]).select("key", "n", "prev_value")
    same(got, df.select("key", "n", F.lag("value").over(window)))


def test_percentiles_of_close_and_far_values(spark):
    """Values between 0 and 1, one far value, equal values, negative ones; every rank is exact."""
    import random

    from docketflow.operators import audit

    random.seed(28)
    groups = {
        "close": [random.random() for _ in range(4000)], "far": [*[random.random() / 1e6 for _ in range(2000)], 1e12], "one": [5.0] * 300,
        "few": [3.0, -7.5], "mixed": [round(random.gauss(0, 3), 2) for _ in range(1500)],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in audit.lower_percentiles(df, ["k"], "v", shares).collect()}
    for k, values in groups.items():
        ordered = sorted(values)
        assert [got[k][n] for n in shares] == [ordered[int((len(ordered) - 1) * p)] for p in shares.values()]
