"""Removal of repeated runs of lines by a suffix array over line numbers.

Lines that occur once end every repeat, so only the others are sorted. Prefix doubling ranks the suffixes
of the line sequences by their first 1, 2, 4, ... lines: a round sorts the pairs (rank, rank a step
further on) over the cluster and numbers them in that order. Suffixes whose rank is theirs alone have no copy and
leave. Ranks of one depth are the suffix array cut at that depth, and suffixes with equal ranks are a
longest-common-prefix interval.

A run counts from ``min_words`` words on. Every line of a maximal repeated run lies in the shortest
such run that starts at some line of it, or in the shortest that ends at some line, so the intervals at
these depths give the lines of all maximal runs. In each interval the earliest stays; the
lines of the later ones are deleted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.registry import query, table
from docketflow.llm.rows import free_name, keyed
from docketflow.session import stored

MIN_WORDS = 50
#: Rows whose runs a worker holds at once.
ROWS = 256
_WORD = r"[^\x20\x09-\x0D]+"


def lines_of(rows: DataFrame) -> DataFrame:
    """(row_key, doc_id, line, value) of rows with ``text``; null texts have no lines."""
    return rows.select("row_key", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "value"))


def in_order(keys: DataFrame, *columns: str) -> DataFrame:
    """Distinct keys with a ``rank`` that rises with their order: files follow each other, and rows in a file."""
    return keyed(keys.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns), "rank")


def repeated_lines(rows: DataFrame) -> DataFrame:
    """Lines that occur more than once, by place, with the rank of their text."""
    lines = lines_of(rows).select(
        "row_key", "doc_id", "line", F.regexp_count("value", F.lit(_WORD)).cast("int").alias("n_words"),
        F.xxhash64("value").alias("high"), F.xxhash64(F.lit(1), "value").alias("low"),
    )
    often = lines.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1")
    return lines.join(in_order(often, "high", "low"), ["high", "low"]).select("row_key", "doc_id", "line", "n_words", "rank")


def doubled(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks by twice as many lines, of the suffixes that share theirs."""
    after = ranks.select("row_key", (F.col("line") - step).alias("line"), F.col("rank").alias("next"))
    pairs = stored(ranks.join(after, ["row_key", "line"]))
    often = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rank").alias("a"), F.col("next").alias("b"))
    named = in_order(often, "a", "b").withColumnRenamed("rank", "new")
    met = pairs.join(named, (F.col("rank") == F.col("a")) & (F.col("next") == F.col("b")))
    return stored(met.select("row_key", "line", F.col("new").alias("rank")))


def shortest_runs(lines: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first line, lines) of the shortest runs with ``least`` words from each line on, and up to each line.

    Runs don't cross a gap in ``lines``.
    """
    found: set[tuple[int, int]] = set()
    edges = np.flatnonzero(np.diff(lines) != 1) + 1
    for part in np.split(np.arange(len(lines)), edges):
        sums = np.concatenate([[0], np.cumsum(words[part])])
        ends = np.searchsorted(sums, sums[:-1] + least, "left")
        starts = np.searchsorted(sums, sums[1:] - least, "right") - 1
        first = int(lines[part[0]])
        found.update((first + n, int(e) - n) for n, e in enumerate(ends) if e < len(sums))
        found.update((first + int(s), n + 1 - int(s)) for n, s in enumerate(starts) if s >= 0)
    return sorted(found)


def windows_of(active: DataFrame, least: int) -> DataFrame:
    """(row_key, doc_id, start, size) of the runs to look up; a row's lines are a part of one text."""

    schema = T.StructType([
        active.schema["row_key"], active.schema["doc_id"], T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType()),
    ])

    def run(batches):
        for batch in batches:
            places, words = batch.column(2), batch.column(3)
            for first in range(0, batch.num_rows, ROWS):
                at, found = [], []
                for n in range(first, min(first + ROWS, batch.num_rows)):
                    runs = shortest_runs(places[n].values.to_numpy().astype(np.int64), words[n].values.to_numpy().astype(np.int64), least)
                    at += [n] * len(runs)
                    found += runs
                pairs = np.array(found, np.int32).reshape(-1, 2)
                taken = [batch.column(k).take(pa.array(at, pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema.names)

    grouped = active.groupBy("row_key").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("line", "n_words"))).alias("places"))
    plain = grouped.select("row_key", "doc_id", F.col("places.line").alias("lines"), F.col("places.n_words").alias("words"))
    return plain.mapInArrow(run, schema)


def later_copies(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row_key, start, size): runs of lines that stand earlier in the corpus.

    Earlier is a smaller doc_id (nulls last), then the row key, then the line. A run may overlap the copy before it.
    """
    active = stored(repeated_lines(rows))
    windows = stored(windows_of(active, min_words))
    depth = windows.agg(F.max("size")).first()[0] or 0
    level = active.select("row_key", "line", "rank")
    levels = level.withColumn("level", F.lit(0))
    step, number = 1, 0
    while 2 * step <= depth:
        level, step, number = doubled(level, step), 2 * step, number + 1
        levels = levels.unionByName(level.withColumn("level", F.lit(number)))
    # The largest power of two that a run holds; its rank at both ends of the run names the run.
    runs = windows.withColumn("level", F.expr("length(bin(size)) - 1")).withColumn("last", F.expr("start + size - shiftleft(1, level)"))
    head = levels.select("row_key", "level", F.col("line").alias("start"), F.col("rank").alias("a"))
    tail = levels.select("row_key", "level", F.col("line").alias("last"), F.col("rank").alias("b"))
    named = stored(runs.join(head, ["row_key", "level", "start"]).join(tail, ["row_key", "level", "last"]).select("row_key", "doc_id", "start", "size", "a", "b"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "start")
    intervals = named.groupBy("size", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = named.join(intervals, ["size", "a", "b"])
    return met.where((F.col("row_key") != F.col("first.row_key")) | (F.col("start") != F.col("first.start"))).select("row_key", "start", "size")


def _cut(texts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    out = []
    for value, first, size in zip(texts, starts, sizes):
        if value is None:
            out.append((0, 0, "", None))
            continue
        lines = value.split("\n")
        gone = np.zeros(len(lines) + 1, np.int64)
        if first is not None:
            np.add.at(gone, first, 1)
            np.add.at(gone, first + size, -1)
        gone = gone.cumsum()[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        ranges = ",".join(f"{a}-{b}" for a, b in zip(edges[::2], edges[1::2]))
        kept = value if not ranges else "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((len(lines), int(gone.sum()), ranges, kept))
    return pd.DataFrame(out, columns=["n_lines", "n_removed", "removed", "text"])


def without_later_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, out: str = "_lines") -> DataFrame:
    """All rows and columns with ``out``: lines, lines removed, their ranges (end exclusive), and the text without them.

    A null text stays null; an empty one is one empty line. Repeated rows are copies of each other: one of them stays
    whole. A text of which everything is removed becomes empty; its row stays.
    """
    key, runs_of = free_name(docs, "_run_row"), free_name(docs, "_runs")
    cut = F.pandas_udf(_cut, "struct<n_lines: int, n_removed: int, removed: string, text: string>")
    rows = keyed(docs, key)
    plain = rows.select(F.col(key).alias("row_key"), F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    runs = later_copies(plain, min_words).groupBy(F.col("row_key").alias(key)).agg(F.collect_list(F.struct("start", "size")).alias(runs_of))
    return rows.join(runs, key, "left").withColumn(out, cut(F.col(text), F.col(runs_of)["start"], F.col(runs_of)["size"])).drop(key, runs_of)


@query("op7_line_runs")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of its repeated line runs; tested against comparing all suffixes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_later_copies(docs).select("doc_id", "_lines.*")
