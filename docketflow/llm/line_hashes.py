"""Removal of repeated units (lines, paragraphs, sentences or clauses) by hashes of normalised units.

Every unit with a word is brought to lower case with single spaces and hashed to 128 bits; none is left out. Of the units
with one digest the earliest by rank (document id, row, place) stays. Repeats that follow each other in a text are a
run, and a run with enough words is removed: its units are listed with their original offsets and, where wanted, cut
out of the texts. Short repeats between new units stay, so a line that unrelated texts share harms nobody, while a passage of many short
lines, or one that begins and ends within a line, goes with all its whole units.

Each task sends one first place for a digest; the units meet the places of digests that come twice, in one join by half a digest.

Null and empty texts have no units. Null ids rank last. Repeated rows repeat each other's units; the first written keeps them. Very long texts
give their units in blocks. An empty table has no repeats. Extra columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.registry import query, table
from docketflow.llm.rows import free_name, keyed

#: Words of a run of repeated units that is removed, where a caller names no other bar.
MIN_WORDS = 20
#: The query's bar: half of a passage's 50 words, for what is lost with the broken sentences at its two ends.
PASSAGE_WORDS = 25
#: What stands between two units.
SEPARATORS = {
    "line": r"\n",
    "paragraph": r"\n\n",
    "sentence": r"\n|(?<=[.!?])\s+|(?<=[。！？])",
    "clause": r"\n|(?<=[.!?,;:])\s+|(?<=[。！？，；：])",
}
#: Units that a task sends at once.
BLOCK = 1 << 14


def normalised(unit: str) -> list[str]:
    return unit.lower().split()


def spans_of(text: str, separator: re.Pattern):
    """(start, end, start of the next) of what stands between separators."""
    start = 0
    for match in separator.finditer(text):
        if match.end() > start:
            yield start, match.start(), match.end()
            start = match.end()
    yield start, len(text), len(text)


def units_of(rows: DataFrame, unit: str = "line") -> DataFrame:
    """Units of the rows (row_key, doc_id, text): both halves of the digest, place and words.

    ``ordinal`` counts the units with a word in a text.
    """
    separator = re.compile(SEPARATORS[unit])
    schema = T.StructType([
        T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("row_key", T.LongType()),
        T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(n, T.LongType()) for n in ("ordinal", "start", "end", "until", "n_words")],
    ])

    def sent(batch, at, out):
        numbers, index = [pa.array(list(c), pa.int64()) for c in zip(*out)], pa.array(at)
        return pa.RecordBatch.from_arrays([*numbers[:2], batch.column(0).take(index), batch.column(1).take(index), *numbers[2:]], schema.names)

    def run(batches):
        for batch in batches:
            at, out = [], []
            for row, value in enumerate(batch.column(2)):
                text, ordinal = value.as_py() or "", 0
                for start, end, until in spans_of(text, separator):
                    words = normalised(text[start:end])
                    if not words:
                        continue
                    digest = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    halves = (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True))
                    at.append(row)
                    out.append((*halves, ordinal, start, end, until, len(words)))
                    ordinal += 1
                    if len(out) >= BLOCK:
                        yield sent(batch, at, out)
                        at, out = [], []
            if out:
                yield sent(batch, at, out)

    return rows.select("row_key", "doc_id", "text").mapInArrow(run, schema)


def repeats(rows: DataFrame, unit: str = "line") -> DataFrame:
    """All units of the rows (row_key, doc_id, text) that repeat an earlier one, with the place of the one that stays.

    ``run_words`` are the words of the run of consecutive repeats that the unit is in.
    """
    units = units_of(rows, unit)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "start")
    # Two digests with one first half are told apart by the least and the greatest second half.
    firsts = units.groupBy("high").agg(
        F.min(F.struct("low", place.alias("place"))).alias("least"), F.min(F.struct(F.bitwise_not("low").alias("low"), place.alias("place"))).alias("most"), F.count("*").alias("n"),
    ).where("n > 1").drop("n")
    first = F.when(F.col("low") == F.col("least.low"), F.col("least.place")).when(F.col("low") == F.bitwise_not("most.low"), F.col("most.place"))
    met = units.join(firsts, "high").withColumn("first", first).drop("least", "most")
    later = met.where((F.col("row_key") != F.col("first.row_key")) | (F.col("start") != F.col("first.start")))
    order = Window.partitionBy("row_key").orderBy("ordinal")
    runs = later.withColumn("run", F.col("ordinal") - F.row_number().over(order))
    return runs.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("row_key", "run"))).select(
        "row_key", "doc_id", "start", "end", "until", "n_words", "run_words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"),
        F.concat(F.lpad(F.hex("high"), 16, "0"), F.lpad(F.hex("low"), 16, "0")).alias("digest"),
    )


def find_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The stored rows with their key, and the repeated units; ``removed`` says whether a unit's run has ``min_words`` words."""
    rows = keyed(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")))
    return rows, repeats(rows, unit).withColumn("removed", F.col("run_words") >= min_words)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with all their columns, and the units of long enough runs of repeats cut from the text with what separates them from the next."""
    key, cuts_of = free_name(docs, "_unit_row"), free_name(docs, "_unit_cuts")
    rows = keyed(docs, key)
    found = repeats(rows.select(F.col(key).alias("row_key"), F.col(id_column).alias("doc_id"), F.col(text).alias("text")), unit).where(F.col("run_words") >= min_words)
    cuts = found.groupBy(F.col("row_key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "until"))).alias(cuts_of))

    @F.pandas_udf("string")
    def cut(texts, lists):
        def one(value, spans):
            if spans is None or not len(spans):
                return value
            out, at = [], 0
            for span in spans:
                out.append(value[at : span["start"]])
                at = span["until"]
            return "".join([*out, value[at:]])

        import pandas as pd

        return pd.Series([one(t, s) for t, s in zip(texts, lists)], dtype=object)

    joined = rows.join(cuts, key, "left")
    return joined.withColumn(text, cut(F.col(text), F.col(cuts_of))).select(*docs.columns)


@query("op9_line_hashes")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all documents that are removed as repeats: those in runs of ``PASSAGE_WORDS`` words; tested against a plain version."""
    found = find_repeats(table(spark, sf_dir, "documents"), unit="sentence", min_words=PASSAGE_WORDS)[1]
    return found.where("removed").drop("row_key", "removed")
