from __future__ import annotations

import numpy as np
from fixtures import awkward, documents, with_clashes

from docketflow.llm import ordinal_quality as op


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = op.trained(docs, op.grades_of(labels.where("doc_id % 2 = 0")))
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    held = op.graded(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    slurs = {"trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron"}
    shown = [r for r in held if r["toxic"] == 1 and slurs & set(r["text"].lower().replace(".", " ").replace(",", " ").split())]
    good = [r for r in held if r["toxic"] == 0 and r["quality"] == 1]
    poor = [r for r in held if r["toxic"] == 0 and r["quality"] == 0]
    assert sum(r["kept"] for r in shown) <= 0.03 * len(shown)
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(r["kept"] for r in poor) <= 0.05 * len(poor)
    assert np.mean([r["expected_grade"] for r in good]) > np.mean([r["expected_grade"] for r in shown]) + 1


def test_gradient_fits_known_weights():
    random = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        on = random.random(6) < 0.4
        score = on @ np.array([2.0, -2.0, 0, 0, 0, 0]) + random.logistic()
        rows.append((int(score > -1) + int(score > 1), np.flatnonzero(on).astype(np.int64)))
    model = op.fit(rows, list(range(6)))
    assert abs(model.weights[0] - 2) < 0.35 and abs(model.weights[1] + 2) < 0.35
    assert abs(model.thresholds[0] + 1) < 0.3 and abs(model.thresholds[1] - 1) < 0.3


def test_awkward_rows_and_one_grade(spark):
    docs = with_clashes(documents(spark, awkward()))
    ratings = spark.createDataFrame([(1, 2), (2, 0), (5, 1), (5, 2), (None, 1), (6, None), (7, 2)], "doc_id long, grade int")
    out = op.graded(docs, op.trained(docs, ratings))
    assert out.count() == len(awkward()) and set(docs.columns) <= set(out.columns)
    alone = op.graded(docs, op.trained(docs, ratings.where("grade = 2")))
    assert alone.where("kept").count() == len(awkward())
    assert op.graded(documents(spark, [], 1), op.trained(docs, ratings)).count() == 0


def test_sample_is_bounded_and_texts_count_once(spark):
    docs = documents(spark, [(n % 40, f"text {n % 10}") for n in range(400)])
    ratings = spark.createDataFrame([(n, n % 3) for n in range(40)], "doc_id long, grade int")
    rows = op.rated_sample(docs, ratings, "doc_id", "text").collect()
    assert len(rows) == 10
    assert op.rated_sample(docs, ratings, "doc_id", "text", 4).count() <= 4


def test_rare_toxic_words_are_learned(spark):
    """Toxic words that each occur in 1 to 3% of the toxic texts, one or two in a text, judged on held-out texts."""
    random = np.random.default_rng(3)
    common, toxic = [f"word{n}" for n in range(400)], [f"slur{n}" for n in range(60)]
    rows, grades = [], []
    for n in range(12_000):
        grade = int(random.choice([0, 2], p=[0.15, 0.85]))
        words = list(random.choice(common, 30, replace=False))
        if grade == 0:
            count = random.integers(1, 3)
            words[:count] = random.choice(toxic, count, replace=False)
        random.shuffle(words)
        rows.append((n, " ".join(words)))
        grades.append((n, grade))
    docs = documents(spark, rows)
    ratings = spark.createDataFrame(grades, "doc_id long, grade int")
    model = op.trained(docs, ratings.where("doc_id < 9000"))
    held = op.graded(docs, model).join(ratings.where("doc_id >= 9000"), "doc_id").collect()
    bad, good = [r for r in held if r["grade"] == 0], [r for r in held if r["grade"] == 2]
    passed, stayed = sum(r["kept"] for r in bad), sum(r["kept"] for r in good)
    print(f"toxic kept {passed} of {len(bad)}, good kept {stayed} of {len(good)}")
    assert passed <= 0.05 * len(bad) and stayed >= 0.97 * len(good)
