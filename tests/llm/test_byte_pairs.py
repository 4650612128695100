from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fixtures import awkward, documents, with_clashes
from pyspark.sql import functions as F

from docketflow.llm import byte_pairs as op


@pytest.fixture(scope="module")
def vocabulary():
    return op.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def spelled(library, text):
    return np.array(library.encode_ordinary(text or ""), "<u4").tobytes()


def test_both_trees_against_the_library(vocabulary, library):
    random.seed(3)
    letters = "aaabcdefgilnorstuéñ日ж"
    pieces = ["".join(random.choice(letters) for _ in range(random.randrange(2, 21))) for _ in range(3000)]
    raw = [p.encode() for p in pieces if 2 <= len(p.encode()) <= op.SHORT and p.encode() not in vocabulary.ranks]
    plain = [np.array(library._core_bpe.encode_single_piece(r), "<u4").tobytes() for r in raw]
    assert op.merge_together(raw, vocabulary) == plain
    assert [np.array(op.merge_one(r, vocabulary), "<u4").tobytes() for r in raw] == plain
    long = b"".join(raw)
    assert op.merge_one(long, vocabulary) == library._core_bpe.encode_single_piece(long)
    # One token all over: the leftmost of equal ranks comes first.
    assert op.merge_one(b"a" * 1001, vocabulary) == library._core_bpe.encode_single_piece(b"a" * 1001)


def test_texts_against_the_library(vocabulary, library):
    random.seed(4)
    letters = "ab  \n\t é日1'st.\U0001f600　\x1c\x85 "
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(60))) for _ in range(4000)]
    for remembered in (op.REMEMBERED, 50):
        encoder = op.Encoder(vocabulary, remembered=remembered)
        for start in range(0, len(texts), 100):
            some = texts[start : start + 100]
            assert encoder.encode(some) == [spelled(library, t) for t in some]
    for text in texts[:500]:
        for size in (1, 7):
            assert "".join(op.blocks_of(text, size)) == text
            assert b"".join(encoder.encode([b])[0] for b in op.blocks_of(text, size)) == spelled(library, text)


def test_white_space_is_that_of_the_pattern():
    import regex

    white = {chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and regex.fullmatch(r"\s", chr(c))}
    assert set(op.WHITE) == white


def test_awkward_rows_and_clashes(spark, library, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 500)
    rows = [*awkward(), (50, "a" * 3000), (51, " " * 3000 + "b"), (52, ("word " * 300).strip())]
    docs = with_clashes(documents(spark, rows))
    out = op.decoded(op.encoded(docs))
    assert out.columns == [*docs.columns, "token_ids", "decoded"]
    got = out.collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str(r) for r in rows)
    for r in got:
        assert bytes(r["token_ids"]) == spelled(library, r["text"]) and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["row_key"] == "clash"


def test_names_nulls_and_empty_tables(spark):
    docs = documents(spark, [(1, "x")], 1)
    with pytest.raises(ValueError, match="text"):
        op.encoded(docs, out="text")
    nulls = op.encoded(docs).withColumn("token_ids", F.lit(None).cast("binary"))
    assert op.decoded(nulls).first()["decoded"] is None
    assert op.decoded(op.encoded(documents(spark, [], 1))).count() == 0


def test_query_over_all_documents(spark, library):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: tuple(r)[1:] for r in op.op13(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = spelled(library, text)
        assert got[doc_id] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
