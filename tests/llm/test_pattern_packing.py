from __future__ import annotations

import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from fixtures import awkward, documents, with_clashes
from tokenizers import Tokenizer

from docketflow.llm import pattern_packing as op


def check(rows, got, capacity=1024):
    engine = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in rows:
        ids = [*engine.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, n, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places), -(-sum(r["length"] for r in got) // capacity)


def test_awkward_rows(spark):
    rows = [*awkward(), (20, "a special <|endoftext|> inside"), (21, "x" * 5000)]
    used, least = check(rows, op.pack(with_clashes(documents(spark, rows))).collect())
    assert used <= least + 1


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    used, least = check(rows, op.pack(docs).collect())
    assert used <= least * 1.01 + 1


def test_ids_are_kept(spark):
    docs = documents(spark, [(1, "one two"), (2, None)])
    assert {(r["doc_id"], len(r["ids"])) for r in op.pieces(docs, with_ids=True).collect()} == {(1, 3), (2, 1)}


def test_empty(spark):
    assert op.pack(documents(spark, [], 1)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram(seed):
    random = np.random.default_rng(seed)
    histogram = random.poisson(random.choice([0.3, 20, 4000]), 1025)
    histogram[0] = 0
    chosen, _ = op.plan(histogram)
    used = np.zeros(1025, np.int64)
    for lengths, times in chosen:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += times
    assert (used == histogram).all()
    total = int((histogram * np.arange(1025)).sum())
    assert sum(t for _, t in chosen) <= max(-(-total // 1024), (histogram[513:]).sum()) * 1.01 + 2


def test_hot_length():
    histogram = np.zeros(1025, np.int64)
    histogram[[3, 300, 700, 724]] = [10**9, 10**10, 7, 10**10]
    chosen, fitted = op.plan(histogram)
    assert fitted and len(chosen) < 50
