from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from docketflow.llm import warc_fixity as op


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit("clash")).repartition(3)


ROWS = [(n, f"http://h/{n}", f"<p>{n}</p>" * (n % 90)) for n in range(900)] + [(None, None, None), (5, "", ""), (5, "", ""), (6, "é", "\U0001f600" * 70_000)]


def plain(a, b):
    """Differences of two replicas by (archive, offset)."""
    x = {(r["archive"], r["offset"]): hashlib.sha256(r["record"].encode()).hexdigest() for r in a}
    y = {(r["archive"], r["offset"]): hashlib.sha256(r["record"].encode()).hexdigest() for r in b}
    kind = {(True, False): "missing", (False, True): "unexpected", (True, True): "corrupt"}
    return {(*k, kind[k in x, k in y]) for k in x.keys() | y.keys() if x.get(k) != y.get(k)}


def test_against_every_record(spark):
    records = op.stored(op.archived(pages(spark, ROWS)))
    for replica in (op.aged(records), records.where("page_id <> 7"), records, records.where("ordinal > 3"), records.limit(0)):
        replica = op.stored(replica)
        found = op.audit(*op.trees(op.digested(records), op.digested(replica), leaf_bytes=2048, fanout=3)).collect()
        assert {(r["archive"], r["offset"], r["status"]) for r in found} == plain(records.collect(), replica.collect())
        assert len(found) == len({(r["archive"], r["offset"]) for r in found})


def test_records_follow_each_other(spark):
    got = op.archived(pages(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    ends = {}
    for r in sorted(got, key=lambda r: (r["archive"], r["ordinal"])):
        assert r["offset"] == ends.get(r["archive"], 0) and r["length"] == len(r["record"].encode())
        ends[r["archive"]] = r["offset"] + r["length"]


def test_only_wrong_branches_are_opened(spark):
    records = op.stored(op.archived(pages(spark, ROWS)))
    a, b = op.trees(op.digested(records), op.digested(records.where("page_id IS NULL OR page_id <> 7")), leaf_bytes=2048, fanout=3)
    assert op.damaged_leaves(a, b).count() == 1
    assert len(a.levels) == len(b.levels) > 2
    assert a.levels[-1].count() == records.select("archive").distinct().count()


def test_empty(spark):
    records = op.archived(pages(spark, []))
    assert op.audit(*op.trees(op.digested(records), op.digested(records))).count() == 0


def test_query_is_the_audit_of_its_replicas(spark):
    from docketflow.llm.registry import QUERIES, table

    sf = "/root/testdata/sf0.001"
    records = op.stored(op.archived(table(spark, sf, "pages")))
    got = {(r["archive"], r["offset"], r["page_id"], r["status"]) for r in QUERIES["op6_warc_fixity"](spark, sf).collect()}
    want = {(r["archive"], r["offset"], r["page_id"], r["status"]) for r in op.audit(*op.trees(op.digested(records), op.digested(op.aged(records)))).collect()}
    assert got == want
