"""Row keys, expressions and binding helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.session import stored

#: Bits of a row key that number the rows of one written file.
FILE_BITS = 36


def keyed(df: DataFrame, name: str = "row_key") -> DataFrame:
    """The rows written to the shared folder, with a unique integer key for each.

    The key is the number of the written file and the row's place in it. Once the table is
    committed the key never changes, whatever executors are lost later, and it needs neither a
    sort nor a column that is unique in the input: repeated rows get different keys.
    """
    rows = stored(df)
    # Also where the input has a column of that name.
    file = rows.metadataColumn("_metadata")
    part = F.regexp_extract(file["file_name"], r"^part-(\d+)", 1).cast("long")
    return rows.withColumn(name, F.shiftleft(part, FILE_BITS) + file["row_index"])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays as it is."""
    # Where all characters are ASCII, lower() does the same and takes far less time.
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Log2 of the bits of a key filter; 2^20 bits are 128 KiB.
FILTER_LOG2 = 20


def key_filter(keys: DataFrame, name: str, log2: int = FILTER_LOG2) -> Column:
    """A bit for the hash of each key as one value of fixed size, for :func:`may_hold`.

    The bits are an aggregate of at most 2^log2 / 64 rows whatever the number of keys. A filter only
    thins rows before an exact join: many keys make it let more through, never less.
    """
    spark = keys.sparkSession
    place = F.pmod(F.xxhash64(name), F.lit(1 << log2))
    bit = F.expr("shiftleft(1L, CAST(p & 63 AS INT))")
    found = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b"))
    full = spark.range(0, (1 << log2) >> 6, 1, 1).withColumnRenamed("id", "w").join(found, "w", "left")
    rows = F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
    return full.agg(F.transform(rows, lambda r: r["b"]).alias("bits")).scalar()


def may_hold(bits: Column, key: Column, log2: int = FILTER_LOG2) -> Column:
    """False only where ``key`` is not in the filter."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << log2))
    word = F.element_at(bits, (F.shiftright(place, 6) + 1).cast("int"))
    return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1
