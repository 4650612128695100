"""Hard negatives by rotated one-bit codes.

Components are scaled to integers; a score is the integer inner product. Every vector x is turned by one random rotation
and coded by the signs b of its components, each of weight 1 / sqrt(D). The code's alignment a = <x, b> is
stored, and what the code leaves, x - a b, is coded again in the same way, ``STAGES`` times. So x = sum a_i b_i + r with a stored
norm of r. An anchor q is turned too and rounded to 8 bits, q = u + e, so that each <u, b_i> is a weighted sum of popcounts
of bit planes. By Cauchy-Schwarz the score lies within |e| |x - r| + |q| |r| of the estimate, without any chance in it.

Anchors and rows are dealt into blocks, and each pair of blocks is one bounded group. In a group, the k-th largest lower end
of the intervals shuts out every row whose upper end is smaller; the others are scored by integers. The best rows of
all groups meet by anchor. With one stage the intervals are too wide to shut out much of 64 dimensions (README); more
stages change the work, never the result.

Rows with a null label, a null vector or any null or non-finite component take no part. Vectors of other lengths count as if they ended in
zeros. Repeated rows are rows of their own; a row is not its own positive, its copy is. Equal scores go by smaller id, null
ids last. Rows without an id are candidates and never anchors. An empty table has no anchors. Extra columns
don't matter. Scores beyond 64 bits fail with ``OverflowError``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.registry import query, table
from docketflow.llm.rows import keyed
from docketflow.session import stored

SCALE = 256
STAGES = 4
PLANES = 8
SEED = 20
#: Rows and anchors of a block, and anchors whose intervals are in memory at once.
ROWS = 2048
ANCHORS = 1024
STEP = 64
N_POSITIVES = 5
N_NEGATIVES = 10
#: Percent of a positive's score between which a negative's lies.
LOW = 30
HIGH = 90

_INDEX = [
    T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("alignments", T.ArrayType(T.DoubleType())),
    T.StructField("coded_norm", T.DoubleType()), T.StructField("rest_norm", T.DoubleType()),
]


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix; the same for the same arguments."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))[0]


def padded(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column as a matrix with zeros where lists are shorter."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def coded(vectors: np.ndarray, turn: np.ndarray, stages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, stages, words), alignments (rows, stages), norms of the coded part and of the rest."""
    turned = vectors.astype(np.float64) @ turn
    width, rest, codes, alignments = turned.shape[1], turned.copy(), [], []
    for _ in range(stages):
        up = rest >= 0
        length = np.abs(rest).sum(axis=1) / math.sqrt(width)
        rest -= np.where(up, 1.0, -1.0) * (length / math.sqrt(width))[:, None]
        codes.append(np.packbits(up, axis=1, bitorder="little").view("<u8"))
        alignments.append(length)
    return np.stack(codes, 1), np.stack(alignments, 1), np.linalg.norm(turned - rest, axis=1), np.linalg.norm(rest, axis=1)


class Anchors:
    """Anchors turned and rounded to bit planes."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        turned = vectors.astype(np.float64) @ turn
        self.norm = np.linalg.norm(turned, axis=1)
        self.low = turned.min(axis=1, initial=0.0)
        spread = turned.max(axis=1, initial=0.0) - self.low
        self.unit = np.where(spread > 0, spread, 1.0) / (2**PLANES - 1)
        steps = np.rint((turned - self.low[:, None]) / self.unit[:, None]).clip(0, 2**PLANES - 1)
        rounded = self.low[:, None] + steps * self.unit[:, None]
        self.total = rounded.sum(axis=1)
        self.error = np.linalg.norm(turned - rounded, axis=1)
        bits = (steps.astype(np.uint8)[:, None, :] >> np.arange(PLANES, dtype=np.uint8)[:, None]) & 1
        self.planes = np.packbits(bits, axis=2, bitorder="little").view("<u8")

    def intervals(self, some: slice, codes: np.ndarray, alignments: np.ndarray, coded_norm: np.ndarray, rest_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of the scores of some anchors with all rows."""
        planes, unit, low = self.planes[some], self.unit[some, None], self.low[some, None]
        words = codes.shape[2]
        estimate = np.zeros((len(planes), len(codes)))
        for stage in range(codes.shape[1]):
            weighted = np.zeros(estimate.shape, np.int32)
            for plane in range(PLANES):
                for word in range(words):
                    shared = np.bitwise_count(planes[:, plane, word, None] & codes[None, :, stage, word])
                    weighted += shared.astype(np.int32) << plane
            ones = np.bitwise_count(codes[:, stage]).sum(axis=1, dtype=np.int64)
            signed = 2 * (low * ones + unit * weighted) - self.total[some, None]
            estimate += alignments[:, stage] * signed
        estimate /= math.sqrt(64 * words)
        norms = self.norm[some, None]
        # The last term stands for the rounding of floating-point numbers.
        width = self.error[some, None] * coded_norm + norms * rest_norm + 1e-9 * (1 + norms * (coded_norm + rest_norm))
        return estimate - width, estimate + width


def indexed(rows: DataFrame, width: int, stages: int = STAGES, seed: int = SEED) -> DataFrame:
    """Rows (row_key, vec_id, label, vector) with their codes."""
    schema = T.StructType([*rows.schema.fields, *_INDEX])

    def run(batches):
        turn = rotation(width, seed)
        for batch in batches:
            codes, alignments, coded_norm, rest_norm = coded(padded(batch.column(3), width), turn, stages)
            lists = [
                pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), flat.reshape(len(codes), -1).shape[1] if len(codes) else 1).cast(pa.list_(kind))
                for flat, kind in ((codes.view(np.int64), pa.int64()), (alignments, pa.float64()))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists, pa.array(coded_norm), pa.array(rest_norm)], schema.names)

    return rows.mapInArrow(run, schema)


class _Group:
    """One block of anchors beside one block of rows."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, width: int, stages: int, seed: int):
        def vectors(rows_: pa.Table) -> np.ndarray:
            return padded(rows_["vector"], width).astype(np.int64)

        self.keys, self.labels = rows["row_key"].to_numpy(), rows["label"].to_numpy()
        ids = rows["vec_id"]
        self.no_id = ids.is_null().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        self.vectors = vectors(rows)
        self.coded = (
            padded(rows["codes"], stages * width // 64).view(np.uint64).reshape(len(self.keys), stages, width // 64),
            padded(rows["alignments"], stages), rows["coded_norm"].to_numpy(), rows["rest_norm"].to_numpy(),
        )
        self.anchor_vectors = vectors(anchors)
        largest = [int(np.abs(v).max(initial=0)) for v in (self.vectors, self.anchor_vectors)]
        if largest[0] * largest[1] * width >= 2**63:
            raise OverflowError("scores don't fit into 64 bits")
        self.anchors = Anchors(self.anchor_vectors, rotation(width, seed))

    def __iter__(self):
        """Each anchor's number with the ends of its intervals."""
        for start in range(0, len(self.anchor_vectors), STEP):
            some = slice(start, min(start + STEP, len(self.anchor_vectors)))
            low, high = self.anchors.intervals(some, *self.coded)
            for k in range(len(low)):
                yield start + k, low[k], high[k]

    def scores(self, anchor: int, rows: np.ndarray) -> np.ndarray:
        return self.vectors[rows] @ self.anchor_vectors[anchor]

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in ``rows`` of the k first by score, id and row."""
        if len(rows) > 4 * k:
            some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
            return some[self.best(rows[some], scores[some], k)] if len(some) < len(rows) else self._first(rows, scores, k)
        return self._first(rows, scores, k)

    def _first(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((self.keys[rows], self.ids[rows], self.no_id[rows], -scores))[:k]


def _kept(low: np.ndarray, high: np.ndarray, among: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``among`` that can be one of the k best, given that those of ``sure`` are candidates."""
    ends = low[sure]
    if len(ends) < k:
        return np.flatnonzero(among)
    return np.flatnonzero(among & (high >= np.partition(ends, -k)[-k]))


def _in_blocks(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int):
    """Both sides grouped so that each block of anchors meets each block of rows once."""
    blocks, slices = max(1, math.ceil(n_anchors / ANCHORS)), max(1, math.ceil(n_rows / ROWS))

    def number(n: int) -> Column:
        return F.pmod(F.xxhash64("row_key"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("anchor_block", number(blocks)).withColumn("row_block", every(slices))
    right = rows.withColumn("row_block", number(slices)).withColumn("anchor_block", every(blocks))
    return left.groupBy("anchor_block", "row_block").cogroup(right.groupBy("anchor_block", "row_block"))


def _by_rank(found: DataFrame, keys: list[str], k: int, key: str, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col(name).asc_nulls_last(), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_POSITIVES = "anchor_key long, positive_key long, positive_id long, score long"
_NEGATIVES = "anchor_key long, anchor_id long, positive_key long, positive_id long, positive_score long, negative_key long, negative_id long, score long"


def _table(columns: list[list[np.ndarray]], names: str, nulls: dict[int, int]) -> pa.Table:
    """Columns from parts; ``nulls`` says which column masks another."""
    fields = [f.split()[0] for f in names.split(", ")]
    joined = [np.concatenate(parts) if parts else np.zeros(0, np.int64) for parts in columns]
    masks = {k: joined[m].astype(bool) for k, m in nulls.items()}
    return pa.table({f: pa.array(joined[k], pa.int64(), mask=masks.get(k)) for k, f in enumerate(fields)})


def _positives(width: int, stages: int, seed: int, k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        if anchors.num_rows and rows.num_rows:
            group = _Group(anchors, rows, width, stages, seed)
            keys, labels = anchors["row_key"].to_numpy(), anchors["label"].to_numpy()
            for a, low, high in group:
                same = (group.labels == labels[a]) & (group.keys != keys[a])
                kept = _kept(low, high, same, same, k)
                scores = group.scores(a, kept)
                first = group.best(kept, scores, k)
                chosen = kept[first]
                for part, values in zip(out, (np.full(len(chosen), keys[a]), group.keys[chosen], group.ids[chosen], scores[first], group.no_id[chosen])):
                    part.append(values)
        return _table(out, _POSITIVES, {2: 4})

    return run


def _negatives(width: int, stages: int, seed: int, k: int, low_percent: int, high_percent: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(10)]
        if anchors.num_rows and rows.num_rows:
            group = _Group(anchors, rows, width, stages, seed)
            keys, labels, ids = anchors["row_key"].to_numpy(), anchors["label"].to_numpy(), anchors["vec_id"].to_numpy()
            positives = anchors["positives"].to_pylist()
            for a, low, high in group:
                other = group.labels != labels[a]
                for positive in positives[a]:
                    least, most = -(-low_percent * positive["score"] // 100), high_percent * positive["score"] // 100
                    there = other & (high >= least) & (low <= most)
                    kept = _kept(low, high, there, there & (low >= least) & (high <= most), k)
                    scores = group.scores(a, kept)
                    inside = (scores >= least) & (scores <= most)
                    kept, scores = kept[inside], scores[inside]
                    first = group.best(kept, scores, k)
                    chosen, n = kept[first], len(first)
                    no_id = positive["positive_id"] is None
                    values = (
                        np.full(n, keys[a]), np.full(n, ids[a]), np.full(n, positive["positive_key"]), np.full(n, 0 if no_id else positive["positive_id"]),
                        np.full(n, positive["score"]), group.keys[chosen], group.ids[chosen], scores[first], np.full(n, no_id), group.no_id[chosen],
                    )
                    for part, value in zip(out, values):
                        part.append(value)
        return _table(out, _NEGATIVES, {3: 8, 6: 9})

    return run


def scaled(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """The rows that take part: vec_id, label, and the vector as integers."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).alias("vector"))
    # NaN compares as the largest number, so that it isn't below infinity either.
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def mined(
    rows: DataFrame, is_anchor: Column, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, low: int = LOW, high: int = HIGH,
    stages: int = STAGES, seed: int = SEED,
) -> DataFrame:
    """Negatives for each anchor and positive from rows (vec_id, label, vector) of :func:`scaled`.

    A negative has another label than the anchor and between ``low`` and ``high`` percent of the positive's score.
    """
    rows = keyed(rows.select("vec_id", "label", "vector")).select("row_key", "vec_id", "label", "vector")
    longest, n_rows = rows.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    width = 64 * max(1, math.ceil((longest or 1) / 64))
    index = stored(indexed(rows, width, stages, seed))
    anchors = index.where(F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull()).select("row_key", "vec_id", "label", "vector")
    n_anchors = anchors.count()
    found = _in_blocks(anchors, index, n_anchors, n_rows).applyInArrow(_positives(width, stages, seed, n_positives), _POSITIVES)
    first = _by_rank(found, ["anchor_key"], n_positives, "positive_key", "positive_id")
    lists = first.groupBy(F.col("anchor_key").alias("row_key")).agg(F.collect_list(F.struct("positive_key", "positive_id", "score")).alias("positives"))
    with_lists = stored(anchors.join(lists, "row_key"))
    met = _in_blocks(with_lists, index, n_anchors, n_rows).applyInArrow(_negatives(width, stages, seed, n_negatives, low, high), _NEGATIVES)
    ranked = _by_rank(met, ["anchor_key", "positive_key"], n_negatives, "negative_key", "negative_id")
    return ranked.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"),
    )


_SQL = """WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negatives AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
  other_id AS negative_id, positive_score, score AS negative_score FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM negatives WHERE rank <= 10"""


@query("op11_hard_negatives", _SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors; every seventh label is shifted first."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(scaled(table(spark, sf_dir, "embeddings"), label=shifted), F.col("vec_id") % 100 == 0)
