from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from fixtures import awkward, documents, with_clashes

from docketflow.llm import vector_shards as op


def law_holds(rows, got, shards=24):
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loads = np.zeros((shards, 3))
    for r in got:
        loads[r["shard"]] += [r["size"], r["tokens"], 1]
    return loads / loads.mean(axis=0)


def test_awkward_rows(spark):
    rows = awkward()
    law_holds(rows, op.shard_table(with_clashes(documents(spark, rows))).collect())


def test_balance_and_whole_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = op.shard_table(docs).collect()
    loads = law_holds([tuple(r) for r in docs.select("doc_id", "text").collect()], got)
    assert loads[:, 0].max() < 1.01 and loads[:, 0].min() > 0.99
    assert loads.max() < 1.05 and loads.min() > 0.95
    homes = defaultdict(set)
    for r in got:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert sum(len(h) > 1 for h in homes.values()) <= 1


def test_a_third_in_one_group(spark):
    rows = [(n, "the same text for all of them") for n in range(3000)] + [(n, f"text {n} " + "w " * (n % 50)) for n in range(3000, 9000)]
    loads = law_holds(rows, op.shard_table(documents(spark, rows, 7)).collect())
    assert loads[:, 0].max() < 1.03 and loads[:, 0].min() > 0.97


def test_empty(spark):
    assert op.shard_table(documents(spark, [], 1)).count() == 0


def test_all_columns_go_to_shards(spark):
    docs = documents(spark, awkward())
    out = op.sharded(docs, 3)
    assert out.drop("shard").count() == len(awkward()) and set(docs.columns) < set(out.columns)


def test_place_takes_the_highest_dot_product():
    vectors = np.array([[10, 10, 10], [6, 6, 1], [4, 4, 9]])
    shards = op.place(vectors, 2)
    assert shards[1] == shards[2] != shards[0]
