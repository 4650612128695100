"""Packing by repeated length patterns.

Texts become token pieces of at most ``capacity`` tokens. Only the histogram of piece lengths, which
has ``capacity`` bins at any corpus size, reaches the driver. There, patterns of two or three lengths that fill
a sequence exactly are enumerated, their repeat counts are fitted to the histogram by non-negative
least squares, rounded down to what the histogram holds, and the pieces that are left are packed
best-fit by counts. The plan says which ranks of each length go to which sequences; pieces find
their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.registry import query, table
from docketflow.session import stored

CAPACITY = 1024
END_ID = 2
NNLS_ROUNDS = 400
#: Bits of a rank in the search key (length, rank).
RANK_BITS = 50


class Encoder:
    """Token ids of a vocabulary file.

    ``tokenizers`` is the definition. The same vocabulary as ranks gives the same ids about four times
    as fast through tiktoken and is taken where both engines read text alike: no special token in
    the text, and no character outside the scripts whose letters and digits have been fixed since early
    Unicode versions.
    """

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            if text.isascii() or np.frombuffer(text.encode("utf-32-le"), "<u4").max() < 0x0250:
                return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def pieces(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """Token pieces of every text with their rank among the pieces of that length in the same task.

    A text is its ids and ``end_id``; a null text is empty. Longer ones are cut into pieces of
    ``capacity`` of which the first may be shorter. ``with_ids`` adds the ids themselves.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    fields = [source.schema["doc_id"], *[T.StructField(n, T.LongType() if n != "piece" else T.IntegerType()) for n in (
        "piece", "start", "length", "ids_crc32", "part", "local_rank")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        import public_tokenizers

        encoder = Encoder(
            tokenizer or public_tokenizers.path("byte_bpe_50k.json"),
            ranks or (None if tokenizer else public_tokenizers.path("byte_bpe_50k.tiktoken")),
        )
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            at, rows, spelled = [], [], []
            for index, value in enumerate(batch.column(1)):
                words = value.as_py()
                ids = array("I", encoder.ids(words) if words else [])
                ids.append(end_id)
                start, number, end = 0, 0, len(ids) % capacity or min(len(ids), capacity)
                while start < len(ids):
                    cut = ids[start:end]
                    at.append(index)
                    rows.append((number, start, end - start, zlib.crc32(cut.tobytes()), part, seen[end - start]))
                    seen[end - start] += 1
                    if with_ids:
                        spelled.append(cut.tolist())
                    start, end, number = end, end + capacity, number + 1
            if not rows:
                continue
            numbers = [pa.array(list(c), pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(zip(*rows))]
            columns = [batch.column(0).take(pa.array(at)), *numbers]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
            if with_ids:
                columns.append(pa.array(spelled, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, T.StructType(fields))


def _patterns(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three lengths that fill a sequence exactly, as rows (a, b, c) with zeros at the end.

    There are about capacity^2 / 12 of them at most, whatever the corpus is.
    """
    there = np.flatnonzero(histogram)
    held = np.zeros(capacity + 1, bool)
    held[there] = True
    out = [(capacity, 0, 0)] if held[capacity] else []
    for a in there[::-1].tolist():
        rest = capacity - a
        if rest <= 0:
            continue
        if rest <= a and held[rest]:
            out.append((a, rest, 0))
        seconds = there[(there <= min(a, rest - 1)) & (2 * there >= rest)]
        seconds = seconds[held[rest - seconds]]
        out += [(a, b, rest - b) for b in seconds.tolist()]
    return np.array(out, np.int64).reshape(-1, 3)


def nnls_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = NNLS_ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram in least squares.

    Accelerated projected gradients, restarted when the step turns back; a pattern touches three bins,
    so a round costs its patterns.
    """
    size = len(histogram)
    scale = max(1.0, float(histogram.max()))
    goal = histogram / scale
    goal[0] = 0

    def apply(x):
        made = np.bincount(patterns.ravel(), np.repeat(x, 3), size)
        made[0] = 0
        return made

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[patterns].sum(axis=1)

    vector = np.ones(len(patterns))
    for _ in range(20):
        vector = back(apply(vector))
        vector /= np.linalg.norm(vector) or 1.0
    step = 1.0 / (float(vector @ back(apply(vector))) * 1.05 + 1e-12)
    x = np.zeros(len(patterns))
    y, momentum = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(apply(y) - goal))
        if (y - new) @ (new - x) > 0:
            momentum = 1.0
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = new + (momentum - 1) / faster * (new - x)
        x, momentum = new, faster
    return x * scale


def _plan_with(patterns: np.ndarray, histogram: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Patterns by their fitted counts, then what is left packed best-fit; and how many came from the fit."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if len(patterns):
        counts = nnls_counts(patterns, histogram.astype(float))
        for k in np.argsort(-counts, kind="stable"):
            times = int(np.round(counts[k]))
            if times < 1:
                break
            lengths, uses = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            times = min(times, int((left[lengths] // uses).min()))
            if times > 0:
                left[lengths] -= uses * times
                out.append((tuple(int(v) for v in patterns[k] if v), times))
    fitted = len(out)
    while left.any():
        lengths, room, uses = [], capacity, {}
        while room:
            fits = [n for n in np.flatnonzero(left[: room + 1])[::-1].tolist() if left[n] > uses.get(n, 0)]
            if not fits:
                break
            lengths.append(fits[0])
            uses[fits[0]] = uses.get(fits[0], 0) + 1
            room -= fits[0]
        times = min(int(left[n]) // k for n, k in uses.items())
        for n, k in uses.items():
            left[n] -= k * times
        out.append((tuple(lengths), times))
    return out, fitted


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(lengths of a sequence, times) that use up the histogram exactly, and how many came from the fit.

    Where most pieces are longer than half a sequence, a triple of short ones leaves a long piece without
    a partner. So the fit runs over three sets of patterns (pairs; those and triples around a long piece; all)
    and the plan with the fewest sequences stays.
    """
    patterns = _patterns(histogram, capacity)
    sets = [patterns[patterns[:, 2] == 0], patterns[(patterns[:, 2] == 0) | (2 * patterns[:, 0] > capacity)], patterns]
    return min((_plan_with(each, histogram, capacity) for each in sets), key=lambda made: sum(t for _, t in made[0]))


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Search keys (length, first rank), the sequence of that rank, and the offset there, by key."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in chosen:
        offset = 0
        for n in lengths:
            rows.append(((n << RANK_BITS) + taken.get(n, 0), base, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        base += times
    found = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def pack(docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, **options) -> DataFrame:
    """Every piece of every row with its sequence and its offset there.

    Repeated rows are packed each for itself. An empty table gives no pieces.
    """
    cut = stored(pieces(docs, id_column, text, capacity, **options))
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    keys, sequences, offsets = slots(plan(histogram, capacity)[0])
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).select(
        *[c for c in cut.columns if c not in ("part", "local_rank")], (F.col("base") + F.col("local_rank")).alias("rank")
    )
    schema = T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = ranked.columns[:-1]

    def place(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            key = (batch.column("length").to_numpy(zero_copy_only=False) << RANK_BITS) + rank
            at = np.searchsorted(keys, key, "right") - 1
            found = [sequences[at] + key - keys[at], offsets[at]]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], *[pa.array(v) for v in found]], [*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, schema)


@query("op4_pattern_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens; tested by unpacking and against the least possible number."""
    return pack(table(spark, sf_dir, "documents"))
