from __future__ import annotations

import random

import numpy as np
import pytest
from fixtures import awkward, documents, with_clashes

from docketflow.llm import line_runs as op


def plain(rows, least):
    """Removed lines of each row by comparing every suffix with every earlier one."""
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    lines = {n: (rows[n][1].split("\n") if rows[n][1] is not None else []) for n in order}
    places, gone = [], {n: set() for n in order}
    for n in order:
        for i in range(len(lines[n])):
            for m, j in places:
                size = 0
                while i + size < len(lines[n]) and j + size < len(lines[m]) and lines[n][i + size] == lines[m][j + size]:
                    size += 1
                if sum(len(x.split()) for x in lines[n][i : i + size]) >= least:
                    gone[n] |= set(range(i, i + size))
            places.append((n, i))
    return sorted((str(rows[n][0]), "\n".join(x for i, x in enumerate(lines[n]) if i not in gone[n]), len(gone[n])) for n in order)


def got_of(frame):
    return sorted((str(r["doc_id"]), r["_lines"]["text"] or "", r["_lines"]["n_removed"]) for r in frame.collect())


@pytest.mark.parametrize("seed", range(2))
def test_random_sequences(spark, seed):
    random.seed(seed)
    words = [f"{a} {b}" for a in "abc" for b in ("x", "y z", "p q r s")] + ["", "lone"]
    rows = [(n, "\n".join(random.choices(words[:5 + seed * 6], k=random.randrange(14)))) for n in range(40)]
    block = "\n".join(random.choices(words, k=9))
    rows += [(100 + n, f"start {n}\n{block}\nend {n}") for n in range(4)]
    assert got_of(op.without_later_copies(documents(spark, rows), min_words=8)) == plain(rows, 8)


def test_awkward_rows(spark):
    rows = [r for r in awkward() if r[0] not in (7, 8)]
    rows += [(50 + n, "one line of five words\n" * 30) for n in range(3)] + [(60, "w " * 60), (61, "head\n" + "w " * 60 + "\ntail")]
    docs = with_clashes(documents(spark, rows))
    out = op.without_later_copies(docs)
    assert set(docs.columns) <= set(out.columns)
    assert got_of(out) == plain(rows, 50)


def test_nothing_repeats_and_empty(spark):
    assert op.without_later_copies(documents(spark, [], 1)).count() == 0
    rows = [(1, "a\nb"), (2, "c")]
    assert got_of(op.without_later_copies(documents(spark, rows), min_words=1)) == plain(rows, 1)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = plain(rows, 50)
    assert got_of(op.without_later_copies(docs)) == want and any(n for _, _, n in want)


def test_shortest_runs():
    lines, words = np.array([0, 1, 2, 5, 6]), np.array([3, 3, 1, 9, 0])
    assert op.shortest_runs(lines, words, 6) == [(0, 2), (0, 3), (5, 1), (5, 2)]
