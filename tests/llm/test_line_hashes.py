from __future__ import annotations

import random
import re

import pytest
from fixtures import awkward, documents, with_clashes

from docketflow.llm import line_hashes as op


def plain(rows, unit="line", least=20):
    """All repeats (doc_id, start, end, kept doc_id, kept start, words of the run, removed); rows of one id in any order."""
    separator = re.compile(f"({op.SEPARATORS[unit]})")
    first, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        run, start, pieces, text = [], 0, [], text or ""
        for match in separator.finditer(text):
            pieces.append((start, match.start()))
            start = match.end()
        for start, end in [*pieces, (start, len(text)), (None, None)]:
            words = () if start is None else tuple(text[start:end].lower().split())
            if words and words in first:
                run.append((i, start, end, *first[words], len(words)))
            elif words or start is None:
                total = sum(r[-1] for r in run)
                out += [(*r[:-1], total, total >= least) for r in run]
                run = []
                if words:
                    first[words] = (i, start)
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(((r["doc_id"], r["start"], r["end"], r["kept_doc_id"], r["kept_start"], r["run_words"], r["removed"]) for r in frame.collect()), key=str)


def corpus():
    random.seed(8)
    lines = [" ".join(f"W{random.randrange(90)}" for _ in range(random.choice([1, 3, 19, 20, 40]))) for _ in range(30)]
    rows = [*awkward()]
    for n in range(120):
        parts = random.choices(lines, k=random.randrange(5)) + [f"own line {n} " + "é\U0001f600 " * random.randrange(15)]
        random.shuffle(parts)
        joined = random.choice(["\n", ". ", ", ", "\n\n", "。"])
        rows.append((200 + n, joined.join(p.upper() if random.random() < 0.1 else p.replace(" ", "  ") for p in parts)))
    return rows


@pytest.mark.parametrize("unit", list(op.SEPARATORS))
def test_against_plain(spark, monkeypatch, unit):
    monkeypatch.setattr(op, "BLOCK", 7)
    rows = corpus()
    found = rows_of(op.find_repeats(with_clashes(documents(spark, rows)), unit=unit)[1])
    assert found == plain(rows, unit) and {r[-1] for r in found} == {True, False}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    removed = [r for r in plain(rows, "sentence", op.PASSAGE_WORDS) if r[-1]]
    got = op.op9(spark, "/root/testdata/sf0.01").collect()
    assert sorted(((r["doc_id"], r["start"], r["end"], r["kept_doc_id"], r["kept_start"], r["run_words"], True) for r in got), key=str) == removed
    assert len(removed) > 500


def test_texts_are_cut_and_columns_stay(spark):
    rows = corpus()
    docs = with_clashes(documents(spark, rows))
    out = op.without_repeats(docs, min_words=1)
    assert out.columns == docs.columns
    texts = [r["text"] for r in out.collect()]
    assert len(texts) == len(rows) and texts.count(None) == sum(t is None for _, t in rows)
    left = [tuple(p.lower().split()) for t in texts for p in (t or "").split("\n")]
    left = [w for w in left if w]
    before = {tuple(p.lower().split()) for _, t in rows for p in (t or "").split("\n")} - {()}
    assert len(left) == len(set(left)) and set(left) == before


def test_passages_in_any_form(spark):
    """Passages of short lines, from mid-line to mid-line, and over a line break; short common lines stay."""
    random.seed(9)

    def words(n):
        return " ".join(f"{random.choice('abcdefgh')}{random.randrange(10**6)}" for _ in range(n))

    short = "\n".join(words(5) for _ in range(12))
    middle = ". ".join(words(8) for _ in range(9))
    common = "Read more, share this.\nMenu"
    rows = [(n, f"{words(30)}\n{common}\n{words(30)}, {words(9)}") for n in range(20)]
    rows += [(100, f"{words(9)}\n{short}\n{words(9)}"), (101, f"{words(20)}.\n{short}"), (102, f"{words(12)}. {middle}. {words(7)}"), (103, f"{words(4)} x {middle} {words(9)}")]
    found = op.find_repeats(documents(spark, rows), unit="clause", min_words=40)[1].collect()
    assert {r["doc_id"] for r in found if r["removed"]} == {101, 103}
    assert sum(r["n_words"] for r in found if r["removed"] and r["doc_id"] == 101) == 60
    assert sum(r["n_words"] for r in found if r["removed"] and r["doc_id"] == 103) == 56
    assert sum(not r["removed"] for r in found) == 19 * 3


def test_cut_takes_the_separator(spark):
    passage = ". ".join(f"one two three four {n}" for n in range(10)) + "."
    rows = [(1, f"Start. {passage} End."), (2, f"Other start, {passage} Other\nend")]
    got = {r["doc_id"]: r["text"] for r in op.without_repeats(documents(spark, rows), unit="sentence", min_words=30).collect()}
    assert got[1] == rows[0][1]
    assert got[2] == "Other start, one two three four 0. Other\nend"


def test_paragraphs(spark):
    block = "one two three\n" + "w " * 20
    rows = [(1, f"a\n\n{block}\n\nb"), (2, f"{block}\n\nc"), (3, "")]
    got = op.find_repeats(documents(spark, rows), unit="paragraph")[1].collect()
    assert [(r["doc_id"], r["start"], r["kept_doc_id"], r["kept_start"], r["removed"]) for r in got] == [(2, 0, 1, 3, True)]


def test_empty(spark):
    assert op.find_repeats(documents(spark, [], 1))[1].count() == 0
