"""Ordinal quality grades by cumulative-link regression on hashed text features.

One weight vector over hashed features is shared by all grades; ordered thresholds cut the score into
grades: P(grade >= k) = 1 / (1 + exp(t_k - score)). Features are the different words of the whole text and
signs of its form, each present or not. The model is fitted on the driver from a bounded sample of
rated rows; every row of the corpus is scored in parallel.
"""

from __future__ import annotations

import math
import operator
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.registry import query, table
from docketflow.llm.rows import free_name, key_filter, may_hold
from docketflow.session import stored

#: Most rated rows that the model is fitted on, the lowest by hash.
MAX_RATED = 20_000
BUCKETS = 1 << 20
#: Chi-square over the grades that a feature needs at least, and how many of the strongest the driver fits.
MIN_CHI, MAX_FEATURES = 25.0, 8192
#: How often chance may lift any of all buckets over the bar.
CHANCE = 0.01
ROUNDS, RATE, RIDGE = 500, 0.1, 1e-4
KEEP = 0.5
#: Steps that a share of the form is measured in.
STEPS = 12

_WORDS = re.compile(rb"[0-9a-z\x80-\xff']+")
_CAPITALS = bytes(range(65, 91))
_SIGNS = b"#*$%&!|<>{}[]@\\^~=+_"


def form_of(text: bytes, words: list[bytes], different: int) -> list[bytes]:
    """Signs of the text's form: every step that a share reaches or passes, and a coarse length."""
    size, n = max(1, len(text)), max(1, len(words))
    shares = {
        b"capitals": (size - len(text.translate(None, _CAPITALS))) / size, b"signs": 4 * (size - len(text.translate(None, _SIGNS))) / size,
        b"different": different / n, b"again": sum(map(operator.eq, words, words[1:])) / n, b"spaces": text.count(b" ") / size,
    }
    out = [b"\x00%s%d" % (name, step) for name, share in shares.items() for step in range(min(STEPS, int(share * STEPS)) + 1)]
    return [*out, b"\x00words%d" % min(4, len(words).bit_length() // 3)]


def buckets_of(text: str | None) -> set[int]:
    """Hashed features of a whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = _WORDS.findall(raw.lower())
    different = set(words)
    different.update(form_of(raw, words, len(different)))
    return {zlib.crc32(w) % BUCKETS for w in different}


def rated_sample(docs: DataFrame, ratings: DataFrame, id_column: str, text: str, most: int = MAX_RATED) -> DataFrame:
    """(grade, buckets) of at most ``most`` rated rows; equal texts count once, with their lowest grade.

    A document with several ratings has the lowest of them.
    """
    rated = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.where(F.col("doc_id").isNotNull() & may_hold(key_filter(rated, "doc_id"), F.col("doc_id")))

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(buckets_of(t)) for t in texts])

    joined = source.join(rated, "doc_id").select("grade", F.xxhash64("text").alias("h"), hashed("text").alias("buckets"))
    # Copies have equal buckets, so any of them stands for all.
    once = joined.groupBy("h").agg(F.min("grade").alias("grade"), F.first("buckets").alias("buckets"))
    return once.orderBy("h").limit(most)


class OrdinalModel:
    """Shared weights by bucket and ordered thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: list[float], grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, text: str | None) -> list[float]:
        """P(grade >= g) for every grade but the lowest."""
        get = self.weights.get
        score = sum(get(b, 0.0) for b in sorted(buckets_of(text)))
        return [float(1 / (1 + np.exp(np.clip(t - score, -500, 500)))) for t in self.thresholds]

    def expected(self, tails: list[float]) -> float:
        return self.grades[0] + sum(p * (b - a) for p, a, b in zip(tails, self.grades, self.grades[1:]))


def chi_bar(grades: int) -> float:
    """Chi-square that chance reaches in one of ``BUCKETS`` features with probability ``CHANCE``, whatever the number of rows."""
    terms, low, high = grades // 2, 0.0, 1e5
    while high - low > 1e-6:
        half = (low + high) / 4
        tail = sum(np.exp(i * np.log(half) - half - math.lgamma(i + 1)) for i in range(terms))
        low, high = (2 * half, high) if tail > CHANCE / BUCKETS else (low, 2 * half)
    return max(MIN_CHI, high)


def screened(sample: DataFrame, sizes: dict[int, int]) -> list[int]:
    """The buckets whose presence differs most between the grades, by chi-square, at most ``MAX_FEATURES``."""
    rows = sum(sizes.values())
    seen = [F.count_if(F.col("grade") == g).cast("double").alias(f"seen_{g}") for g in sizes]
    counts = sample.select("grade", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("total"), *seen)
    chi = F.lit(0.0)
    for grade, size in sizes.items():
        wanted = F.col("total") * (size / rows)
        chi = chi + F.pow(F.col(f"seen_{grade}") - wanted, 2) / F.greatest(wanted * (1 - F.col("total") / rows), F.lit(1e-9))
    strong = counts.select("bucket", "total", chi.alias("chi")).where((F.col("chi") >= chi_bar(len(sizes))) & (F.col("total") >= 5))
    return sorted(r["bucket"] for r in strong.orderBy(F.desc("chi"), "bucket").limit(MAX_FEATURES).collect())


def fit(rows: list[tuple[int, np.ndarray]], buckets: list[int]) -> OrdinalModel | None:
    """The model of (grade, buckets) rows over the given buckets; none where all have one grade."""
    grades = sorted({g for g, _ in rows})
    if len(grades) < 2:
        return None
    count = len(grades)
    levels = np.array([grades.index(g) for g, _ in rows])
    kept = np.array(buckets, np.int64)
    columns, owners = [], []
    for n, (_, b) in enumerate(rows):
        at = np.searchsorted(kept, b[np.isin(b, kept)])
        columns.append(at)
        owners.append(np.full(len(at), n))
    columns, owners = np.concatenate(columns).astype(np.int64), np.concatenate(owners).astype(np.int64)
    n = len(rows)
    above = np.array([(levels >= k).mean() for k in range(1, count)])
    cuts = -np.log(above / (1 - above))
    # The first threshold and the logs of the gaps keep the thresholds in order.
    values = np.concatenate([np.zeros(len(kept)), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    first, second = np.zeros_like(values), np.zeros_like(values)

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    for step in range(1, ROUNDS + 1):
        weights, gaps = values[: len(kept)], np.exp(values[len(kept) + 1 :])
        ordered = values[len(kept)] + np.concatenate([[0.0], np.cumsum(gaps)])
        edges = np.concatenate([[-np.inf], ordered, [np.inf]])
        score = np.bincount(owners, weights[columns], n)
        low, high = sigmoid(edges[levels] - score), sigmoid(edges[levels + 1] - score)
        mass = np.maximum(high - low, 1e-12)
        slope = (low + high - 1) / n
        by_low, by_high = low * (1 - low) / mass / n, high * (1 - high) / mass / n
        by_edge = np.bincount(levels + 1, by_high, count + 1)[1:count] - np.bincount(levels, by_low, count + 1)[1:count]
        tail = by_edge[::-1].cumsum()[::-1]
        gradient = np.concatenate([
            -np.bincount(columns, slope[owners], len(kept)) + RIDGE * weights, [-tail[0]], -tail[1:] * gaps,
        ])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        values = values - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    ordered = values[len(kept)] + np.concatenate([[0.0], np.cumsum(np.exp(values[len(kept) + 1 :]))])
    return OrdinalModel({int(b): float(w) for b, w in zip(kept, values)}, ordered.tolist(), grades)


def trained(docs: DataFrame, ratings: DataFrame, id_column: str = "doc_id", text: str = "text", most: int = MAX_RATED) -> OrdinalModel | None:
    """The model of ``ratings`` (doc_id, grade) on the texts of ``docs``."""
    sample = stored(rated_sample(docs, ratings, id_column, text, most).select("grade", "buckets"))
    sizes = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count("*").alias("n")).orderBy("grade").collect()}
    if len(sizes) < 2:
        return None
    kept = screened(sample, sizes)

    @F.pandas_udf("array<int>")
    def of_kept(lists: pd.Series) -> pd.Series:
        wanted = set(kept)
        return pd.Series([[b for b in each if b in wanted] for each in lists])

    # The driver gets the few screened features of each sampled row, not its words.
    found = sample.select("grade", of_kept("buckets").alias("buckets")).collect()
    return fit([(r["grade"], np.asarray(r["buckets"], np.int64)) for r in found], kept)


def graded(docs: DataFrame, model: OrdinalModel | None, text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows with ``expected_grade``, ``tail_probability`` of the highest grade, and ``kept``.

    Null and empty texts have the form of an empty text and are judged by it. Repeated rows get equal results.
    Without a model nothing is known: both numbers are null and every row is kept. Columns of these names are replaced;
    :func:`accepted` leaves all columns as they are.
    """
    name = free_name(docs, "_graded")
    out = docs.withColumn(name, verdict_of(F.col(text), model, keep))
    return out.withColumns({n: F.col(name)[n] for n in ("expected_grade", "tail_probability", "kept")}).drop(name)


def accepted(docs: DataFrame, model: OrdinalModel | None, text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows that :func:`graded` keeps, with their columns as they are."""
    name = free_name(docs, "_graded")
    return docs.withColumn(name, verdict_of(F.col(text), model, keep)).where(F.col(name)["kept"]).drop(name)


def verdict_of(text: Column, model: OrdinalModel | None, keep: float = KEEP) -> Column:
    """Expected grade, tail probability of the highest grade, and whether that reaches ``keep``, as one struct."""
    if model is None:
        none = F.lit(None).cast("double")
        return F.struct(none.alias("expected_grade"), none.alias("tail_probability"), F.lit(True).alias("kept"))

    @F.pandas_udf(T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        tails = [model.tails(t) for t in texts]
        last = np.array([t[-1] for t in tails], np.float64)
        return pd.DataFrame({"expected_grade": np.array([model.expected(t) for t in tails], np.float64), "tail_probability": last, "kept": last >= keep})

    return run(text)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of a labels table: 0 toxic, 1 poor, 2 good."""
    grade: Column = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.cast("int").alias("grade"))


@query("op8_ordinal_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade and verdict of every document; tested by accuracy on held-out labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, grades_of(table(spark, sf_dir, "labels")))
    return graded(docs, model).drop("text")
