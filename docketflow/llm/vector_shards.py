"""Sharding by vector bin packing.

Each group of equal texts has a vector of bytes, tokens and rows. Groups are placed, largest first, in
the shard where the dot product of that vector with the shard's residual capacity is highest. Groups
above a fixed share of a shard are placed on their own: a share bounds how many there can be. The
others are hashed into a fixed number of bundles and a bundle is placed like a group. So the driver
places a bounded number of vectors at any corpus size. A group larger than a shard's fair part in
some dimension can't stay whole with balanced shards and is dealt out in pieces by row key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketflow.llm.registry import query, table
from docketflow.llm.rows import keyed

SHARDS = 24
#: Bundles for each shard, and the part of a shard above which a group is placed on its own.
FINE = 512
#: Pieces for each fair part of a shard that an oversized group fills.
PIECES = 8
#: Bytes that each row costs besides its text.
ROW_BYTES = 8
DIMENSIONS = ("bytes", "tokens", "rows")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (bytes, tokens, rows), decided in the order of the largest dimension.

    Capacity is an equal part of each dimension. A shard is open to a vector while it has room for it in
    every dimension; where none has, the one whose fullest dimension ends lowest takes it.
    """
    totals = vectors.sum(axis=0).astype(float)
    parts = vectors / np.where(totals > 0, totals, 1.0) * shards
    room = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for k in np.lexsort((np.arange(len(parts)), -parts.max(axis=1))):
        part = parts[k]
        after = room - part
        open_ = (after >= 0).all(axis=1)
        best = int(np.argmax(np.where(open_, room @ part, -np.inf))) if open_.any() else int(np.argmax(after.min(axis=1)))
        out[k], room[best] = best, after[best]
    return out


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def measured(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Narrow rows with a stable key: size, tokens, checksum and group hash. Null texts are empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return keyed(docs.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(value) + ROW_BYTES).cast("long").alias("size"), token_count(value).alias("tokens"),
        F.crc32(value.cast("binary")).alias("text_crc32"), F.xxhash64(value).alias("grp"),
    ))


def assigned(rows: DataFrame, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """The rows of :func:`measured` with their shard."""
    spark = rows.sparkSession
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = rows.groupBy("grp").agg(*sums)
    totals = rows.agg(*sums).first()

    def over(part: float) -> Column:
        bounds = [F.col(d) > (totals[d] or 0) * part for d in DIMENSIONS]
        return bounds[0] | bounds[1] | bounds[2]

    alone = over(1.0 / (shards * fine))
    bundle = F.pmod(F.xxhash64("grp"), F.lit(shards * fine))
    items = groups.select(alone.alias("alone"), F.when(alone, F.col("grp")).otherwise(bundle).alias("item"), over(1.0 / shards).alias("large"), *DIMENSIONS)
    items = items.groupBy("alone", "item", "large").agg(*[F.sum(d).alias(d) for d in DIMENSIONS])
    # Bounded: shards * fine bundles and as many single groups for each dimension.
    found = items.orderBy("alone", "item").collect()
    split = {r["item"]: int(np.ceil(PIECES * shards * max(r[d] / totals[d] for d in DIMENSIONS if totals[d]))) for r in found if r["large"]}
    placed = [(r["alone"], r["item"], 0, *[r[d] for d in DIMENSIONS]) for r in found if not r["large"]]
    piece = F.lit(0).cast("long")
    for item, pieces in split.items():
        piece = F.when(F.col("grp") == item, F.pmod(F.xxhash64("row_key"), F.lit(pieces))).otherwise(piece)
    rows = rows.withColumn("piece", piece)
    if split:
        cut = rows.where(F.col("grp").isin(list(split))).groupBy("grp", "piece").agg(*sums).orderBy("grp", "piece").collect()
        placed += [(True, r["grp"], r["piece"], *[r[d] for d in DIMENSIONS]) for r in cut]
    vectors = np.array([p[3:] for p in placed], np.int64).reshape(-1, 3)
    chosen = place(vectors, shards).tolist() if placed else []
    plan = spark.createDataFrame([(*p[:3], s) for p, s in zip(placed, chosen)], "alone boolean, item long, piece long, shard int")
    # Both maps have a bounded number of rows, see above.
    own = F.broadcast(plan.where("alone").select(F.col("item").alias("grp"), "piece", F.col("shard").alias("own_shard")))
    shared = F.broadcast(plan.where("NOT alone").select(F.col("item").alias("bundle"), "shard"))
    out = rows.join(own, ["grp", "piece"], "left").withColumn("bundle", F.pmod(F.xxhash64("grp"), F.lit(shards * fine)))
    return out.join(shared, "bundle", "left").withColumn("shard", F.coalesce("own_shard", "shard")).drop("own_shard", "bundle", "piece")


def with_slots(rows: DataFrame) -> DataFrame:
    """A gapless number from 0 for the rows of each shard, in the order of their row keys.

    A shard's rows are numbered file by file of the stored rows, each behind the counts of the earlier files.
    """
    rows = rows.withColumn("part", F.shiftright("row_key", 36))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row_key")) - 1
    return rows.withColumn("inside", inside).join(bases, ["shard", "part"]).withColumn("slot", F.col("base") + F.col("inside"))


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text", fine: int = FINE) -> DataFrame:
    """All columns of ``docs`` with a ``shard`` balanced by bytes, tokens and rows, for ``write.partitionBy('shard')``."""
    kept = keyed(docs, "_shard_row")
    narrow = kept.select(
        F.col("_shard_row").alias("row_key"), (F.octet_length(F.coalesce(text, F.lit(""))) + ROW_BYTES).cast("long").alias("size"),
        token_count(F.coalesce(F.col(text), F.lit(""))).alias("tokens"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("grp"),
    )
    places = assigned(narrow, shards, fine).select(F.col("row_key").alias("_shard_row"), "shard")
    return kept.drop("shard").join(places, "_shard_row").drop("_shard_row")


def shard_table(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs`` with its shard and slot under the law of near-equal bytes.

    A null text counts as empty. Repeated rows are rows of one group. Equal texts share a shard unless
    their group is larger than a shard's fair part. An empty table gives no rows.
    """
    out = with_slots(assigned(measured(docs, id_column, text), shards))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )


@query("op1_vector_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards balanced by bytes, tokens and rows; tested by its law and against plain counts."""
    return shard_table(table(spark, sf_dir, "documents"))
