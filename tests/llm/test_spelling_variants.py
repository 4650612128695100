from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from fixtures import awkward, documents, with_clashes

from docketflow.llm import spelling_variants as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, min_chars=6, min_count=5, every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = [n, len(near), best if best is not None and counts[best] >= 5 * n else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row += [counts[row[2]] if row[2] else None, root]
    return {w: tuple(r) for w, r in out.items()}


def result(frame):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in frame.collect()}


def test_all_pairs_of_random_words(spark):
    """Words of few letters: grams come twice, ties are many, chains have several steps."""
    random.seed(12)
    words = {}
    for size, letters in ((6, "ab"), (7, "abc"), (9, "éab"), (4, "abcd")):
        for _ in range(250):
            words["".join(random.choice(letters) for _ in range(size))] = random.choice([5, 6, 25, 26, 130, 131, 700, 4000])
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    found = result(op.variants(frame))
    assert found == plain_variants(words)
    assert sum(r[1] for r in found.values()) > 2000 and any(r[2] and r[2] != r[4] for r in found.values())
    pairs = [(r["word"], r["near"]) for r in op.near_pairs(frame).collect()]
    assert len(pairs) == len(set(pairs)) == sum(r[1] for r in found.values())


def test_pivots_are_the_cheapest_disjoint_pair():
    random.seed(13)
    for _ in range(500):
        places = random.sample(range(12), random.randrange(3, 7))
        prefix = [(random.randrange(20), 0, p) for p in places]
        cost = {p: f for f, _, p in prefix}
        chosen = op.pivots_of(prefix)
        a, b = sorted(chosen)
        assert b - a >= 2
        assert cost[a] + cost[b] == min(cost[x] + cost[y] for x in places for y in places if y - x >= 2)


def corpus():
    random.seed(14)
    base = ["".join(random.choice("abcdeéàmnorst") for _ in range(random.randrange(5, 11))) for _ in range(150)]
    rows = list(awkward())
    for i in range(400):
        text = []
        for _ in range(60):
            w = random.choice(base[: random.choice([5, 20, 150])])
            if random.random() < 0.1:
                at = random.randrange(len(w))
                w = w[:at] + random.choice(["", "x", w[at] * 2]) + w[at + 1 :]
            text.append(w.upper() if random.random() < 0.05 else w)
        rows.append((1000 + i, random.choice([" ", ", ", "\n", "1"]).join(text)))
    return rows


@pytest.mark.parametrize("block", [op.BLOCK, 50])
def test_counts_of_awkward_rows(spark, monkeypatch, block):
    rows = corpus()
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "HELD", 40 if block == 50 else op.HELD)
    got = op.word_counts(with_clashes(documents(spark, rows)), every=7)
    assert {r["word"]: r["n"] for r in got.collect()} == plain_counts(rows, every=7)


def test_query(spark, tmp_path):
    rows = corpus()
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = result(op.op12(spark, str(tmp_path)))
    assert found == plain_variants(plain_counts(rows)) and any(r[2] for r in found.values())


def test_empty(spark):
    assert op.variants(op.word_counts(documents(spark, [], 1))).count() == 0
    assert op.variants(op.word_counts(documents(spark, [(1, None), (2, "")]))).count() == 0
