from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm import hard_negatives as op

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
])


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(rows, every=100, shift=True, k=5, n=10):
    """Rows of the result by comparing every anchor with every row."""
    taken = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if shift and vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        taken.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for a, (anchor, q, label) in enumerate(taken):
        if anchor is None or anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i is None, i or 0, b, c) for b, (i, v, c) in enumerate(taken) if b != a]
        scored.sort()
        positives = [s for s in scored if s[4] == label][:k]
        for p in positives:
            allowed = [s for s in scored if s[4] != label and -30 * p[0] <= -100 * s[0] <= -90 * p[0]][:n]
            out += [(anchor, None if p[1] else p[2], r, None if s[1] else s[2], -p[0], -s[0]) for r, s in enumerate(allowed, 1)]
    return sorted(out, key=str)


def found(spark, rows, **more):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    docs = frame(spark, rows)
    for name in ("row_key", "codes", "vector", "rank", "score", "positives", "anchor_block"):
        docs = docs.withColumn(name, F.lit("clash"))
    return sorted(map(tuple, op.mined(op.scaled(docs, label=shifted), F.col("vec_id") % 100 == 0, **more).collect()), key=str)


def corpus(n=700, width=64, seed=1, labels=4):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((6, width))
    rows = []
    for i in range(n):
        v = centres[draw.integers(6)] * draw.uniform(0, 1.5) + draw.standard_normal(width)
        rows.append((i, [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)], int(draw.integers(labels))))
    return rows


@pytest.mark.parametrize("stages", [1, 4])
def test_against_all_pairs_in_many_blocks(spark, monkeypatch, stages):
    monkeypatch.setattr(op, "ROWS", 200)
    monkeypatch.setattr(op, "ANCHORS", 3)
    monkeypatch.setattr(op, "STEP", 2)
    rows = corpus()
    got = found(spark, rows, stages=stages)
    assert got == plain(rows) and len(got) > 100


def test_intervals_hold_the_scores():
    draw = np.random.default_rng(2)
    for width, spread in ((64, 40), (128, 3000), (192, 0)):
        vectors = draw.integers(-spread - 1, spread + 1, (300, width))
        vectors[:5] = 0
        vectors[5] = 7
        turn = op.rotation(width)
        assert np.allclose(turn @ turn.T, np.eye(width))
        anchors = op.Anchors(vectors[:50], turn)
        widths = []
        for stages in (1, 2, 4):
            low, high = anchors.intervals(slice(0, 50), *op.coded(vectors, turn, stages))
            scores = vectors[:50] @ vectors.T
            assert (low <= scores).all() and (scores <= high).all()
            widths.append((high - low).mean())
        assert widths[0] > widths[1] > widths[2]


def test_awkward_rows(spark):
    random.seed(5)
    rows = corpus(250, 8, 3, 2)
    nan, inf = float("nan"), float("inf")
    rows += [
        (300, None, 1), (301, [1.0] * 8, None), (302, [1.0, None], 1), (303, [nan] * 8, 1), (304, [inf] * 8, 0), (None, [0.5] * 8, 1), (None, [0.5] * 8, 0),
        (400, [], 1), (401, [0.5], 0), (500, [0.25] * 12, 1), (501, [0.2] * 70, 0), (-100, [0.1] * 8, 0),
    ]
    rows += [rows[0], rows[100], rows[3], rows[200]]  # repeated rows, anchors among them
    rows += [(600 + i, [0.25] * 8, i % 2) for i in range(40)]  # ties
    got = found(spark, rows)
    assert got == plain(rows) and len(got) > 50


def test_empty_and_one_sided_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(100, [1.0], 1)]) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_scores_beyond_64_bits(spark):
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(100, [1e12] * 64, 1), (1, [1e12] * 64, 1)])


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(map(tuple, op.op11(spark, folder).collect()), key=str)
    assert got == plain(rows) and got
