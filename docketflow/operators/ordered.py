"""Ordered work inside a key that may hold a large share of all rows.

A plain window puts one key into one task. Here the key's order is cut into buckets, each bucket
is worked on by itself, and one small row per (key, bucket) carries what the earlier buckets
leave behind. Neighbours of a key with few rows are found without buckets. Both the bucket summary and the carry rows are bounded by the number of buckets, and
the summary is a partial aggregate, so a hot key is spread over as many tasks as it has buckets.

``bucket`` has to grow with the first ordering column: a day of a timestamp, a page number, a
position divided by a width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"
_FIRST = "__carry"
_HOT = "__hot"
#: Rows of a key that one task may put in order; the keys with more are cut into buckets.
WHOLE = 100_000


def time_bucket(moment: Column, seconds: int = 86_400) -> Column:
    """A bucket number for an instant or a wall-clock reading."""
    return F.floor(F.unix_micros(moment.cast("timestamp")) / F.lit(seconds * 1_000_000))


def number_bucket(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width))


def _key_columns(keys: Sequence[str]) -> list[Column]:
    return [F.col(key) for key in keys]


def _bucketed(df: DataFrame, keys: Sequence[str], bucket: Column, whole: Column) -> DataFrame:
    """The rows with their bucket where their key has many rows, and ``whole`` where one task takes the whole key.

    Nearly all keys are small, and need no carry rows. There are at most rows / ``WHOLE`` others, which are broadcast.
    """
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_HOT)).where(F.col(_HOT) > WHOLE)
    hot = F.broadcast(many.select(*[F.col(key).alias(f"__k_{n}") for n, key in enumerate(keys)], _HOT))
    same = [F.col(key).eqNullSafe(F.col(f"__k_{n}")) for n, key in enumerate(keys)]
    found = df.join(hot, same, "left")
    return found.select(*df.columns, F.when(F.col(_HOT).isNotNull(), bucket).otherwise(whole).alias(_BUCKET), F.col(_HOT).isNotNull().alias(_HOT))


def _union_carry(df: DataFrame, carry: DataFrame) -> DataFrame:
    rows = df.withColumn(_FIRST, F.lit(1))
    return rows.unionByName(carry.withColumn(_FIRST, F.lit(0)), allowMissingColumns=True)


def previous_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Add each row's values from the row before it in its key (NULL for the first one).

    ``order`` must be a total order inside a key. Also adds ``<prefix>exists``.
    """
    return _neighbour_values(df, keys, order, bucket, values, prefix, forward=False)


def next_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: Sequence[str],
    prefix: str = "next_",
) -> DataFrame:
    """Add each row's values from the row after it in its key (NULL for the last one)."""
    return _neighbour_values(df, keys, order, bucket, values, prefix, forward=True)


def _neighbour_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
    values: Sequence[str], prefix: str, forward: bool,
) -> DataFrame:
    # Nothing is carried back to rows without a bucket, whether their key is cut or not.
    whole = F.when(bucket.isNotNull(), F.lit(0).cast("long")) if forward else F.lit(None).cast("long")
    placed = _bucketed(df, keys, bucket, whole)
    rows = placed.drop(_HOT)
    packed = F.struct(*[F.col(name) for name in values])
    position = F.struct(*[F.col(name) for name in order])
    edge = F.min_by(packed, position) if forward else F.max_by(packed, position)
    edges = placed.where(_HOT).groupBy(*keys, _BUCKET).agg(edge.alias("__edge"))
    by_key = Window.partitionBy(*keys).orderBy(_BUCKET)
    # The edge row moves into the neighbouring bucket that has rows.
    target = F.lag(_BUCKET).over(by_key) if forward else F.lead(_BUCKET).over(by_key)
    carry = (
        edges.withColumn("__target", target)
        .where(F.col("__target").isNotNull())
        .select(*keys, F.col("__target").alias(_BUCKET), F.col("__edge").alias("__own"))
    )
    stacked = _union_carry(rows.withColumn("__own", packed), carry)
    inside = [F.col(name).asc() for name in order]
    if forward:
        window = Window.partitionBy(*keys, _BUCKET).orderBy(F.col(_FIRST).desc(), *inside)
        neighbour = F.lead("__own").over(window)
    else:
        window = Window.partitionBy(*keys, _BUCKET).orderBy(F.col(_FIRST).asc(), *inside)
        neighbour = F.lag("__own").over(window)
    found = stacked.withColumn("__near", neighbour).where(F.col(_FIRST) == 1)
    extra = [F.col("__near").getField(name).alias(f"{prefix}{name}") for name in values]
    return found.select(*df.columns, *extra, F.col("__near").isNotNull().alias(f"{prefix}exists"))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    totals: dict[str, Column],
) -> DataFrame:
    """Add running sums over each key, the current row included.

    A total of ``F.lit(1)`` numbers the rows.
    """
    return _running(df, keys, order, bucket, totals, F.sum, F.sum)


def running_maxima(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    maxima: dict[str, Column],
) -> DataFrame:
    """Add running maxima over each key, the current row included."""
    return _running(df, keys, order, bucket, maxima, F.max, F.max)


def _running(df, keys, order, bucket, measures, partial, merge) -> DataFrame:
    names = list(measures)
    rows = df.withColumn(_BUCKET, bucket).withColumns({f"__m_{n}": c for n, c in measures.items()})
    parts = rows.groupBy(*keys, _BUCKET).agg(*[partial(f"__m_{n}").alias(f"__m_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        *keys, _BUCKET, *[merge(f"__m_{n}").over(earlier).alias(f"__m_{n}") for n in names]
    )
    stacked = _union_carry(rows, carry)
    upto = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(F.col(_FIRST).asc(), *[F.col(name).asc() for name in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    done = stacked.select(
        *df.columns, _FIRST, *[merge(f"__m_{n}").over(upto).alias(n) for n in names]
    )
    return done.where(F.col(_FIRST) == 1).drop(_FIRST)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. A partial aggregate, so equal keys shrink before the shuffle."""
    return _extreme(df, keys, order, F.max_by)


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return _extreme(df, keys, order, F.min_by)


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [name for name in df.columns if name not in keys]
    packed = F.struct(*[F.col(name) for name in rest])
    best = df.groupBy(*keys).agg(pick(packed, F.struct(*[F.col(name) for name in order])).alias("__row"))
    return best.select(*keys, *[F.col("__row").getField(name).alias(name) for name in rest]).select(*df.columns)


def trailing_counts(
    df: DataFrame, keys: Sequence[str], moment: str, order: Sequence[str], seconds: int, count_name: str
) -> DataFrame:
    """Count the rows of a key in the ``seconds`` up to each row, the current row included.

    Also adds ``gap_micros``, the distance to the row before if that lies in reach. A row is
    needed by its own bucket and by the next one only, so every task sees two bucket widths.
    """
    width = seconds * 1_000_000
    rows = df.withColumn("__micros", F.unix_micros(F.col(moment).cast("timestamp")))
    home = F.floor(F.col("__micros") / F.lit(width))
    copies = rows.withColumn("__home", home).withColumn(
        _BUCKET, F.explode(F.array(F.col("__home"), F.col("__home") + 1))
    )
    ordered = Window.partitionBy(*keys, _BUCKET).orderBy("__micros")
    span = ordered.rangeBetween(-(width - 1), Window.currentRow)
    chain = Window.partitionBy(*keys, _BUCKET).orderBy(*[F.col(name) for name in order])
    counted = copies.withColumn(count_name, F.count(F.lit(1)).over(span)).withColumn(
        "gap_micros", F.col("__micros") - F.lag("__micros").over(chain)
    )
    return counted.where(F.col(_BUCKET) == F.col("__home")).select(*df.columns, count_name, "gap_micros")
