from __future__ import annotations

import hashlib
import random
import re

from fixtures import awkward, documents, with_clashes
from pyspark.sql import functions as F

from docketflow.llm import decontamination as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows, items):
    out = []
    for i, text in rows:
        own, hit, met = words(text), set(), set()
        for item, phrase in items:
            w = words(phrase)
            size = min(10, len(w))
            windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
            for k in range(len(own) - size + 1):
                if tuple(own[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    if item is not None:
                        met.add(str(item))
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((i, len(own), len(hit), len(met), digest, bool(hit)))
    return sorted(out, key=str)


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [
    (1, "one two three four"), (2, "word7x7 word8x8 WORD9x9!! word10x10 word11x11 word12x12 word13x13 word14x14 word15x15 word16x16 word17x17 word18x18"),
    (3, None), (4, ""), (5, "naïve café"), (6, "one two three four"), (None, "line a"), (7, "a a a a a a a a a a a a"), (8, "missing terms only"), (9, "line"),
]


def test_awkward_rows(spark):
    rows = [*awkward(), (30, "a " * 25), (31, "b " + "a " * 10 + "c"), (32, "One, two. THREE four one two three four")]
    got = op.contamination(with_clashes(documents(spark, rows)), items_frame(spark, ITEMS))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, ITEMS)


def test_random_texts(spark):
    random.seed(3)
    rows = [(n, " ".join(random.choice("abcde") for _ in range(random.randrange(60)))) for n in range(60)]
    items = [(n, " ".join(random.choice("abcde") for _ in range(random.randrange(1, 14)))) for n in range(25)]
    for n in range(0, 60, 3):
        rows.append((100 + n, f"x y {items[n % 25][1]} z {rows[n][1]}"))
    got = op.contamination(documents(spark, rows), items_frame(spark, items))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, items)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = op.contamination(docs, items).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, [tuple(r) for r in items.collect()])
    assert any(r["contaminated"] for r in got)


def test_empty_sides(spark):
    assert op.contamination(documents(spark, [], 1), items_frame(spark, ITEMS)).count() == 0
    got = op.contamination(documents(spark, awkward()), items_frame(spark, [])).collect()
    assert sorted(map(tuple, got), key=str) == expected(awkward(), [])


def test_clean_keeps_columns(spark):
    docs = with_clashes(documents(spark, awkward()))
    kept = op.clean(docs, items_frame(spark, ITEMS))
    dirty = [r[0] for r in expected(awkward(), ITEMS) if r[5]]
    assert kept.columns == docs.columns
    assert kept.count() == len(awkward()) - len(dirty)


def test_proximity(spark):
    rows = [(1, "red fox runs"), (2, "red big fox runs"), (3, "red very big and old fox runs"), (4, "fox red"), (5, "runs runs")]
    items = items_frame(spark, [(1, "red fox runs")])
    index = op.Index(documents(spark, rows).select("text"), op.phrases_of(items))
    gaps = {r["gap"] for r in index.proximity(1).collect()}
    assert gaps <= {-1, 0, 1} and 0 in gaps and len(gaps) > 1
    assert index.proximity(0).select(F.col("digest")).distinct().count() <= index.proximity(2).select("digest").distinct().count()


def test_words_are_lowered_one_by_one(spark):
    """Only A-Z are lowered, in texts of ASCII and others; words taken before lowering are the same."""
    given = [(1, "Plain ASCII, with 3 WORDS"), (2, "ÉCOLE École İstanbul STRAẞE ΣΊΣΥΦΟΣ ABCé"), (3, "\U0001f600 Ünï\x00Z\x7f"), (4, ""), (5, None)]
    own = F.transform(op.raw_words_of(F.col("text")), op.lower_ascii)
    for r in documents(spark, given).select("text", own.alias("own"), op.words_of(F.col("text")).alias("w")).collect():
        assert r["own"] == r["w"] == words(r["text"])
