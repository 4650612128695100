"""Plan boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed before any later filter or join looks at it.

    The optimizer moves filters, and the NOT NULL checks it adds for join keys, below projections
    and repeats the projected expressions there. For parsed JSON that would parse every text many
    times. Filters do not cross a projection with a nondeterministic column that a filter above it
    reads; columns that nobody reads are still left out of it.
    """
    names = [F.col(name) for name in df.columns]
    placed = df.select(*names, F.spark_partition_id().alias("__placed"))
    return placed.where(F.col("__placed") >= 0).select(*names)
