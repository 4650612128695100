"""The page stream: what it stores with a batch, and what it refuses."""

from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from docketflow.functions import codes as C
from docketflow.functions import jsonvalue as J
from docketflow.sources import pages as P
from docketflow.sources import tables
from docketflow.streaming import page_stream

DAY = dt.datetime(2026, 10, 1, 12)


def source(ident, number="00000010020268090001", **fields):
    return {"id": ident, "numeroProcesso": number, "tribunal": "TJGO", **fields}


def pages(spark, batches, revision=0, collection="c1"):
    rows = []
    for n, sources in enumerate(batches):
        hits = [{"_id": s["id"], "_source": s, "sort": [k, s["id"]]} for k, s in enumerate(sources)]
        payload = json.dumps({"hits": {"total": len(hits), "hits": hits}}, ensure_ascii=False)
        rows.append((collection, revision + n, DAY + dt.timedelta(days=n), "TJGO", "demo", payload))
    return spark.createDataFrame(rows, P.PAGE_SCHEMA)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """One page with an accepted and a rejected hit."""
    out = page_stream.FactStore(str(tmp_path_factory.mktemp("facts")))
    moves = [{"codigo": 7}, {"codigo": 7}, {"codigo": 8}]
    page_stream.ingest_batch(pages(spark, [[source("a", movimentos=moves), source("bad", number="1")]]), "first", out)
    return out


REFUSED = [
    ([[source("a", grau="G9"), source("bad", number="1")]], "position with other content"),
    ([[source("a", movimentos=[{"codigo": 7}, {"codigo": 7}, {"codigo": 8}]), source("bad", number="1"), source("c")]], "page with another number of hits"),
    ([[source("a", movimentos=[{"codigo": 7}, {"codigo": 7}, {"codigo": 8}]), source("bad", number="2")]], "rejected position with other content"),
    ([[source("a", movimentos=[{"codigo": 7}, {"codigo": 7}, {"codigo": 8}]), source("bad")]], "position both accepted and rejected"),
    ([[source("a", number="3"), source("bad", number="1")]], "position both accepted and rejected"),
]


@pytest.mark.parametrize("batch, reason", REFUSED)
def test_replay_is_refused(spark, store, batch, reason):
    found = {r["reason"] for r in page_stream.check_batch(pages(spark, batch), store).collect()}
    assert reason in found
    with pytest.raises(page_stream.ReplayConflict):
        page_stream.ingest_batch(pages(spark, batch), "again", store)
    assert page_stream.observations(spark, store).count() == 1


def test_one_batch_may_not_contradict_itself(spark, store):
    twice = pages(spark, [[source("m")]], 5).unionByName(pages(spark, [[source("m", grau="G2")]], 5))
    assert {r["reason"] for r in page_stream.check_batch(twice, store).collect()} == {"position with other content"}
    origins = pages(spark, [[source("n")], [source("n", number="00000020020268090002")]], 7)
    assert {r["reason"] for r in page_stream.check_batch(origins, store).collect()} == {"origin with two case numbers"}
    known = pages(spark, [[source("a", number="00000020020268090002")]], 9)
    assert {r["reason"] for r in page_stream.check_batch(known, store).collect()} == {"origin with two case numbers"}


def test_faithful_replay_adds_nothing_and_movements_are_stored(spark, store):
    same = pages(spark, [[source("a", movimentos=[{"codigo": 7}, {"codigo": 7}, {"codigo": 8}]), source("bad", number="1")]])
    assert page_stream.check_batch(same, store).isEmpty()
    page_stream.ingest_batch(same, "replay", store)
    assert page_stream.observations(spark, store).count() == 1
    assert sorted(r["copies"] for r in page_stream.facts(spark, store, "contents").collect()) == [1, 2]
    assert sorted(r["last_ordinal"] for r in page_stream.occurrences(spark, store).collect()) == [1, 2]
    assert page_stream.facts(spark, store, "snapshots").where("is_complete").count() == 1


def test_uncommitted_batches_are_not_seen(spark, tmp_path):
    out = page_stream.FactStore(str(tmp_path / "facts"))
    page_stream.ingest_batch(pages(spark, [[source("a")]]), "one", out)
    rows = page_stream.observations(spark, out)
    tables.write_batch(rows.withColumn("page_key", F.lit("half")), out.path("observations"), "broken", "collection_id")
    assert page_stream.observations(spark, out).count() == 1
    assert spark.read.parquet(out.path("observations")).count() == 2


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    out = page_stream.FactStore(str(tmp_path / "facts"))
    for n in range(6):
        page_stream.ingest_batch(pages(spark, [[source(f"s{n}")]], collection=f"collection {n}"), f"b{n}", out)
    batch = pages(spark, [[source("s0")]], collection="collection 0")
    buckets = tables.touched_buckets(batch, "collection_id")
    rows = page_stream.facts(spark, out, "observations", page_stream.observations(spark, out).schema, buckets)
    assert len(buckets) == 1 and rows.count() >= 1
    plan = rows._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*bucket#\d+ (=|IN)", plan)


def test_string_hits_break_the_page(spark):
    rows = [("c", 0, DAY, "TJGO", "demo", p) for p in ('{"hits":{"hits":["{\\"sort\\":[1]}"]}}', '{"hits":{"hits":[{"sort":[1]}]}}')]
    got = [r["page_error"] for r in P.with_envelope(spark.createDataFrame(rows, P.PAGE_SCHEMA)).collect()]
    assert got == ["HIT_NOT_SOUND", None]


def test_codes_in_deep_lists(spark):
    texts = ["[" * d + '{"codigo":"007"}' + "]" * d for d in (0, 1, 5, 30)] + ['[{"codigo":1},[[{"codigo":2}],3],{"codigo":true}]', "5", "[]"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = [r["c"] for r in df.select("n", C.nested_codes(F.try_parse_json("t")).alias("c")).orderBy("n").collect()]
    assert got == [["7"]] * 4 + [["1", "2"], [], []]


def test_redaction_at_any_depth(spark):
    number = "1" * 20
    texts = ['{"q":{"search_after":[1,[2,3]]},"x":1.0}', f'{{"a":["{number}"],"{number}":"{number}0"}}', '{"search_after":7}', f'"\\u0031{number[1:]}"', "nope", None]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = [r["r"] for r in df.select("n", J.redact(F.col("t")).alias("r")).orderBy("n").collect()]
    hidden = "<numeroProcesso-observado-redigido>"
    assert got == [
        '{"q":{"search_after":["<cursor-redigido>","<cursor-redigido>"]},"x":1.0}', f'{{"{number}":"{number}0","a":["{hidden}"]}}',
        '{"search_after":7}', f'"{hidden}"', None, None,
    ]


def raw_page(spark, sorts, revision=0, collection="k", payload=None):
    """One page whose hits have these sort lists."""
    hits = [{"_id": f"{collection}{revision}-{n}", "_source": source(f"{collection}{revision}-{n}"), "sort": s} for n, s in enumerate(sorts)]
    text = json.dumps({"hits": {"total": len(hits), "hits": hits}}) if payload is None else payload
    return spark.createDataFrame([(collection, revision, DAY + dt.timedelta(days=revision), "TJGO", "demo", text)], P.PAGE_SCHEMA)


SORT = ("asc", "desc")


@pytest.fixture(scope="module")
def cursor_store(spark, tmp_path_factory):
    """Revisions 2 and 6 of a collection, in two batches; an empty page between them."""
    out = page_stream.FactStore(str(tmp_path_factory.mktemp("cursors")))
    page_stream.ingest_batch(raw_page(spark, [[10, "m"], [10, "c"], [12, "z"]], 2), "two", out, sort=SORT)
    page_stream.ingest_batch(raw_page(spark, [[40, "a"]], 6).unionByName(raw_page(spark, [], 5)), "six", out, sort=SORT)
    return out


CURSORS = [
    ([[12, "y"], [39, "a"]], 4, None),
    ([[12, "z"], [13, "a"]], 4, "cursor repeated or went back"),
    ([[11, "a"]], 4, "cursor repeated or went back"),
    ([[13, "b"], [13, "b"]], 4, "cursor repeated or went back"),
    ([[13, "b"], [13, "c"]], 4, "cursor repeated or went back"),
    ([[13, "b"], [40, "a"]], 4, "cursor repeated or went back"),
    ([[13, "b"], ["14", "b"]], 4, "cursor value of another type"),
    ([[13.0, "b"]], 4, "cursor value of another type"),
    ([[13, "b"], [None, "b"]], 4, "cursor value of another type"),
    ([[13, None], [13, None]], 4, "cursor repeated or went back"),
    ([[13, "b"], [14]], 4, "cursor with another number of sort values"),
    ([[13]], 4, "cursor with another number of sort values"),
    ([[41, "a"]], 7, None),
    ([[1, "a"], [9, "b"]], 1, None),
    ([[10, "m"]], 1, "cursor repeated or went back"),
    ([], 4, None),
]


@pytest.mark.parametrize("sorts, revision, reason", CURSORS)
def test_cursors_inside_and_across_batches(spark, cursor_store, sorts, revision, reason):
    page = raw_page(spark, sorts, revision)
    assert {r["reason"] for r in page_stream.check_batch(page, cursor_store, SORT).collect()} == ({reason} if reason else set())
    # Other collections have cursors of their own, and without an approved sort nothing is asked.
    assert page_stream.check_batch(page, cursor_store).isEmpty()


def test_cursor_breaks_are_not_stored(spark, cursor_store):
    before = page_stream.observations(spark, cursor_store).count()
    with pytest.raises(page_stream.ReplayConflict, match="cursor"):
        page_stream.ingest_batch(raw_page(spark, [[11, "a"]], 4), "back", cursor_store, sort=SORT)
    assert page_stream.observations(spark, cursor_store).count() == before


def test_a_broken_page_is_judged_afresh(spark, tmp_path):
    """A failed attempt is logged, and the right page under the same key is taken afterwards; good pages beside it are stored."""
    out = page_stream.FactStore(str(tmp_path / "facts"))
    for n, payload in enumerate(('{"hits":{"hits":["no hit"]}}', "[]", '{"hits":{"hits":[{"sort":[1]}],"total":-1}}')):
        broken = raw_page(spark, [], 0, payload=payload)
        page_stream.ingest_batch(broken.unionByName(raw_page(spark, [[5, "a"]], n + 1)), f"try {n}", out)
    assert page_stream.observations(spark, out).count() == 3 and page_stream.facts(spark, out, "pages").count() == 3
    right = raw_page(spark, [[1, "a"], [2, "a"]], 0)
    assert page_stream.check_batch(right, out).isEmpty()
    page_stream.ingest_batch(right, "right", out)
    assert page_stream.observations(spark, out).count() == 5
    errors = [r["page_error"] for r in page_stream.facts(spark, out, "attempts").orderBy("page_error").collect()]
    assert errors == ["ENVELOPE_NOT_OBJECT", "HIT_NOT_SOUND", "TOTAL_INVALID"]


def test_known_pages_are_not_opened(spark, tmp_path, monkeypatch):
    out = page_stream.FactStore(str(tmp_path / "facts"))
    same = pages(spark, [[source("a")], [source("b")]])
    page_stream.ingest_batch(same, "one", out)
    monkeypatch.setattr(page_stream, "_opened", lambda *a: pytest.fail("a known page was opened"))
    page_stream.ingest_batch(same, "two", out)
    assert page_stream.observations(spark, out).count() == 2


def test_reprocessing_writes_and_keeps_newer_projections(spark, tmp_path):
    from docketflow.streaming import repairs

    out = page_stream.FactStore(str(tmp_path / "facts"))
    moves = [{"codigo": 3}, {"codigo": 3}]
    first = [source("old", number="1"), source("lost", number="2", movimentos=moves), source("worse", number="3"), source("fine")]
    page_stream.ingest_batch(pages(spark, [first, [source("old", grau="G2")]]), "first", out)
    hits = {r["hit_ordinal"]: r for r in repairs.open_rejections(spark, out).collect()}
    good = "00000010020268090001"
    texts = {1: hits[1]["hit"].replace('"1"', f'"{good}"'), 2: hits[2]["hit"].replace('"2"', f'"{good}"'), 3: hits[3]["hit"].replace("TJGO", "TJXX")}
    mended = spark.createDataFrame([(hits[n]["collection_id"], hits[n]["page_key"], n, t) for n, t in texts.items()], "collection_id string, page_key string, hit_ordinal int, hit string")
    for batch in ("repair", "repair", "again"):
        repairs.reprocess(spark, out, batch, mended)
    assert page_stream.observations(spark, out).count() == 2  # nothing that was observed is rewritten
    assert {r["hit_ordinal"] for r in repairs.resolutions(spark, out).collect()} == {1, 2}
    assert {(r["hit_ordinal"], r["validation_code"]) for r in repairs.open_rejections(spark, out).collect()} == {(3, "CNJ_INVALID")}
    assert page_stream.facts(spark, out, "versions").count() == 4
    seen = {r["version_id"]: r["first_observed_at"] for r in page_stream.facts(spark, out, "versions").collect()}
    rows = {r["representation_id"]: r for r in repairs.projection(spark, out).collect()}
    assert len(rows) == 3 and sorted(r["first_observed_at"] for r in rows.values()) == [DAY, DAY, DAY + dt.timedelta(days=1)]
    assert all(seen[r["version_id"]] == r["first_observed_at"] for r in rows.values())
    assert [r["copies"] for r in page_stream.facts(spark, out, "contents").collect()] == [2]
    other = mended.where("hit_ordinal = 3").withColumn("hit", F.lit(hits[3]["hit"].replace('"3"', f'"{good[:-1]}2"').replace("worse", "fine")))
    with pytest.raises(page_stream.ReplayConflict, match="two case numbers"):
        repairs.reprocess(spark, out, "conflict", other)


def test_event_numbers_go_on_over_batches(spark, tmp_path):
    from docketflow.streaming import events

    out = page_stream.FactStore(str(tmp_path / "facts"))
    batches = [[("a", 3, 1), ("a", 1, 2), ("b", 9, 3)], [("a", 0, 4), ("c", 5, 5), ("a", 0, 6)], [], [("b", 1, 7)]]
    for n in (0, 1, 1, 2, 3, 0):
        rows = [(r, DAY + dt.timedelta(days=d), i) for r, d, i in batches[n]]
        events.append_events(spark.createDataFrame(rows, "run_id string, moment timestamp, event_id long"), f"b{n}", out)
    got = {r["event_id"]: (r["run_id"], r["event_number"]) for r in events.numbered_events(spark, out).collect()}
    assert got == {2: ("a", 1), 1: ("a", 2), 3: ("b", 1), 4: ("a", 3), 6: ("a", 4), 5: ("c", 1), 7: ("b", 2)}


def test_collection_progress(spark, tmp_path):
    """Sums of batches, a budget, rejections, an empty last page; a replay adds nothing."""
    out = page_stream.FactStore(str(tmp_path / "facts"))
    page_stream.ingest_batch(pages(spark, [[source("a"), source("bad", number="1")], [source("c")]]), "one", out)
    page_stream.ingest_batch(pages(spark, [[source("x")]], collection="c2"), "two", out)

    def state(budget=None):
        names = ["collection_id", "pages_confirmed", "hits_confirmed", "valid_hits", "rejected_hits", "checkpoint_revision", "source_total", "query_status", "coverage"]
        return sorted(tuple(r) for r in page_stream.collection_progress(spark, out, budget).select(*names).collect())

    assert state() == [("c1", 2, 3, 2, 1, 2, 1, "running", None), ("c2", 1, 1, 1, 0, 1, 1, "running", None)]
    assert state(3)[0][-2:] == ("limit", "partial")
    ends = pages(spark, [[]], 2).unionByName(pages(spark, [[]], 1, "c2"))
    for name in ("ends", "ends again"):
        page_stream.ingest_batch(ends, name, out)
    assert state() == [("c1", 3, 3, 2, 1, 3, 1, "exhausted", "partial"), ("c2", 2, 1, 1, 0, 2, 1, "exhausted", "complete")]
