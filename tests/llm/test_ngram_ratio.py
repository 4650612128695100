from __future__ import annotations

import re

from fixtures import awkward, documents, with_clashes

from docketflow.llm import ngram_ratio as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {k + j for starts in windows.values() if len(starts) > 1 for k in starts for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


EXTRA = [
    (40, "a b c d e f g h " * 9), (41, "p q " + "r s t u v w x y " + "z " * 30 + "r s t u v w x y"), (42, "k\nk\n \nk\nm\n\n"),
    (43, " ".join(f"t{i}" for i in range(25)) + " # * $ %% & | < >"), (44, "a a a a a a a a a"),
]


def test_base_columns(spark):
    rows = [*awkward(), *EXTRA]
    docs = with_clashes(documents(spark, rows))
    got = op.judged(docs, op.trusted(docs, labels(spark, [(7, 1, 0), (43, 1, 0), (None, 1, 0), (41, 1, 0), (41, 0, 0)]))).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((i, *base(t)) for i, t in rows), key=str)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_no_target_and_no_rows(spark):
    docs = documents(spark, [*awkward(), *EXTRA])
    for r in op.judged(docs, op.trusted(docs, labels(spark, []))).collect():
        assert r["score"] == 0 and r["kept"] == (not r["base_failed"])
    none = documents(spark, [], 1)
    assert op.judged(none, op.trusted(none, labels(spark, []))).count() == 0


def test_junk_goes_and_good_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    given = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    # Half of the labels train, the other half is held out.
    got = op.judged(docs, op.trusted(docs, given.where("doc_id % 2 = 0")))
    held = got.where("n_words >= 20").join(given.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["kept"] for r in held if r["quality"] == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in held if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(junk) <= 0.02 * len(junk)


def test_scores_are_means_of_log_ratios(spark):
    """The same counts and means in plain Python, from the operator's own buckets."""
    import math

    docs = documents(spark, [*awkward(), *EXTRA])
    target = docs.where("doc_id in (7, 43)")
    grams = {}
    for name, df in (("raw", docs), ("target", target)):
        grams[name] = [r[1] for r in df.select("doc_id", op.buckets_of(op.F.coalesce("text", op.F.lit("")))).collect()]
    counts = {n: {} for n in grams}
    totals = {n: [0, 0] for n in grams}
    for n, lists in grams.items():
        for b in (b for each in lists for b in each):
            counts[n][b] = counts[n].get(b, 0) + 1
            totals[n][b >= op.BUCKETS] += 1

    def ratio(b):
        k = b >= op.BUCKETS
        share = (counts["raw"].get(b, 0) + 1) / (totals["raw"][k] + op.BUCKETS)
        return math.log((counts["target"].get(b, 0) / totals["target"][k] + op.PRIOR * share) / (1 + op.PRIOR) / share)

    want = sorted(round(sum(map(ratio, g)) / len(g), 6) if g else 0.0 for g in grams["raw"])
    got = sorted(round(r["score"], 6) for r in op.judged(docs, target).collect())
    assert all(abs(a - b) < 2e-6 for a, b in zip(want, got))


def test_forms_and_pairs(spark):
    """A sign for each run of capitals, other letters and marks, and digits; pairs of equal words have buckets of their own."""
    given = [(1, "Ab ÉCole ǅx ªb é́ ́A 一二 ٣4Ⅷ aAAa9b"), (2, "ab ab cd ab ab"), (3, "one"), (4, "")]
    forms = documents(spark, given).select("doc_id", op.forms_of(op.F.col("text")).alias("f")).collect()
    old = op.F.regexp_replace(op.F.regexp_replace(op.F.regexp_replace("text", r"\p{Lu}+", "A"), r"[\p{L}\p{M}&&[^A]]+", "a"), r"\p{N}+", "0")
    assert sorted(map(tuple, forms)) == sorted(map(tuple, documents(spark, given).select("doc_id", old).collect()))
    found = {r["doc_id"]: r["b"] for r in documents(spark, given).select("doc_id", op.buckets_of(op.F.col("text")).alias("b")).collect()}
    assert {k: len(b) for k, b in found.items()} == {1: 17, 2: 9, 3: 1, 4: 0}
    first, second, third, fourth = found[2][5:]
    assert first == fourth != second == third >= op.BUCKETS


def test_marked_rows_count_once_for_both(spark):
    """All rows with one pass over their n-grams give what a target of its own gives: ids may repeat or be null."""
    docs = documents(spark, [*awkward(), *EXTRA, (43, "another text of the same id"), (None, "a row without an id")])
    given = labels(spark, [(7, 1, 0), (43, 1, 0), (43, 1, 0), (None, 1, 0), (41, 1, 0), (41, 0, 0), (42, 1, 1), (999, 1, 0)])
    once = op.marked(docs, given)
    assert once.count() == docs.count() and once.where("raw <> 1").count() == 0
    good = op.trusted(docs, given).select("text")
    assert sorted(map(str, once.where("target = 1").select("text").collect())) == sorted(map(str, good.collect()))
    want = op.judged(docs, op.trusted(docs, given)).collect()
    assert sorted(map(str, op.scored(docs, op.log_ratios(once)).collect())) == sorted(map(str, want))


def test_repeats_as_hashes_of_half_windows_find_them(spark):
    """Windows next to, over and apart from each other, and texts whose half windows alone repeat."""
    window = "a b c d e f g h"
    texts = [
        f"{window} {window}", f"x {window} y z {window}", "a " * 8, "a " * 9, "a b " * 5, "a b c " * 4, f"{window} a b c d e f g",
        " ".join(f"a b c d {i}" for i in range(30)), " ".join(f"a b c d e f g {i}" for i in range(9)), "a b c", "", f"{window} 1 b c d e f g h",
    ]
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "i int, words array<string>")
    got = {r["i"]: r["n"] for r in op.with_repeated_words(rows, "words", "n").collect()}
    assert got == {i: base(t)[4] for i, t in enumerate(texts)}
