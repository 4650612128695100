"""A sample of the registered queries against their SQL; tests/compare.py runs all of them."""

from __future__ import annotations

import pytest
from compare import ROOT, compare, oracle_connection

import __spark_entry__ as entry_points
from docketflow.plans import registry

SAMPLE = [
    "overview_stats", "theme_distribution", "facet_preset", "filter_same_representation", "discovery_or", "page_contract",
    "capture_outcomes", "movement_content", "snapshot_diff", "alteration_statuses", "publication_swap", "watch_intervals",
    "decision_requests", "rolling_quota", "page_boundaries", "evidence_matrix", "percentile_lower", "canonical_hash",
]
# The smallest data set has no rows for these.
LARGER = {"discovery_or": "sf0.01"}


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    sf = LARGER.get(name, "sf0.001")
    df = entry_points.queries()[name](spark, f"{ROOT}/{sf}")
    count, extra, missing = compare(df, oracle_connection(sf), entry_points.oracle_sql()[name])
    assert not extra and not missing
    assert count > 0
