from __future__ import annotations

import sys

from fixtures import awkward, documents, with_clashes
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from docketflow.llm import ordinal_quality
from test_anchor_dedup import plain_alike
from test_decontamination import expected as plain_matches
from test_line_runs import plain as plain_lines
from test_pattern_packing import check as packing_check

SF = "/root/testdata/sf0.001"


def stages_of(spark, docs, tmp_path):
    out = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def checked(spark, before):
    """Every stage against a plain version of it on its own input."""
    rows = [texts(df) for df in before[:-1]]
    labels = ordinal_quality.grades_of(spark.read.parquet(f"{SF}/labels.parquet"))
    model = ordinal_quality.trained(before[0], labels)
    good = [(i, t) for i, t in rows[0] if model is None or model.tails(t)[-1] >= ordinal_quality.KEEP]
    assert sorted(rows[1], key=str) == sorted(good, key=str)
    assert sorted((str(i), t or "") for i, t in rows[2]) == [(i, t) for i, t, _ in plain_lines(rows[1], 50)]
    classes = plain_alike([t for _, t in rows[2]], True)
    assert len(set(plain_alike([t for _, t in rows[2]], False))) <= len(rows[3]) <= len(set(classes))
    assert len(rows[3]) == len({classes[rows[2].index(r)] for r in rows[3]})
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r[0] for r in plain_matches(rows[3], items) if not r[5]]
    assert sorted((i for i, _ in rows[4]), key=str) == sorted(clean, key=str)
    used, least = packing_check(rows[4], before[-1].collect())
    assert used <= least * 1.01 + 1


def test_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = stages_of(spark, docs, tmp_path)
    for df in out[:-1]:
        assert df.columns == docs.columns and [f.dataType for f in df.schema] == [f.dataType for f in docs.schema]
    checked(spark, out)
    assert len({df.count() for df in out[:-1]}) > 2


def test_awkward_rows(spark, tmp_path):
    checked(spark, stages_of(spark, documents(spark, awkward()), tmp_path))


#: Names that stages use inside, besides those of the fixture.
INSIDE = [
    "_lines", "_graded", "_cuts", "_runs", "_run_row", "_component_row", "_metadata", "expected_grade", "tail_probability", "digest", "fingerprint",
    "component_id", "sequence_id",
]


def test_clashing_columns(spark, tmp_path):
    """Every stage but the last leaves extra columns alone, whatever they are called, and decides as without them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = with_clashes(docs)
    for name in INSIDE:
        more = more.withColumn(name, F.lit(f"own {name}"))
    clash = [c for c in more.columns if c not in docs.columns]
    plain, extra = stages_of(spark, docs, tmp_path / "plain"), stages_of(spark, more, tmp_path / "extra")
    for a, b in zip(plain[:-1], extra[:-1]):
        assert b.columns == more.columns and sorted(texts(a), key=str) == sorted(texts(b), key=str)
        assert all(r[c] == ("clash" if c not in INSIDE else f"own {c}") for r in b.select(*clash).distinct().collect() for c in clash)
    assert plain[-1].count() == extra[-1].count()


def test_tables_without_a_size_column(spark, tmp_path):
    docs = documents(spark, awkward()).drop("n_chars")
    assert all(df.columns == docs.columns for df in stages_of(spark, docs, tmp_path)[:-1])


def test_run_is_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = stages_of(spark, docs, tmp_path)[-1]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, pipeline.run(spark, SF).select(key).collect())) == sorted(map(tuple, last.select(key).collect()))


def test_no_stage_is_empty(spark):
    none = documents(spark, [], 1)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


assert sys.modules["corpus_pipeline"].ORACLE_SQL is None
