"""SimHash near-duplicates by anchor-point covering.

The fingerprint's bits are cut into bands. In each band the anchors are the words of a covering code:
a Hamming code of covering radius 1 over the first 2^r - 1 bits, every word over the few bits left.
A fingerprint lives at its nearest anchor and is copied to each anchor within that radius plus the
band's share of the threshold. Two fingerprints at d or fewer differing bits differ in at most
d // bands bits of some band, so one of them meets the other at its anchor. Fingerprints
are compared in full at each anchor, so nothing else is reported.

One band over all 64 bits is the plain form of the method; no known code of 64 bits gives it fewer
than hundreds of copies for each fingerprint. Three bands of 21 bits need 41 copies over 2^17
anchors each, two bands of 32 bits about 340 over 2^27. More anchors suit more fingerprints;
every setting finds the same links.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm.registry import query, table
from docketflow.llm.rows import free_name, keyed
from docketflow.session import cut_lineage, stored

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42
BANDS = 3
#: For documents that are alike: words of a shingle, similarity of the shingle sets, and fingerprints of a sketch.
ALIKE_SHINGLE = 5
SIMILARITY = 0.8
SKETCH = 5
#: Standard deviations by which the bits of a pair may differ from what is expected of its similarity.
SLACK = 1.3
FIRST_SLACK = 3.5
#: Nodes that crowd an anchor, besides as many times the mean of all anchors.
CROWD = 8
#: Edges that one task may join to components.
ONE_TASK = 1 << 18
#: Shingles whose bits are counted at once; bounds the memory of very long texts.
BLOCK = 1 << 16

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number; no words give zero."""
    return int(sketch(text, shingle, 1)[0])


def sketch(text: str | None, shingle: int, size: int) -> np.ndarray:
    """``size`` fingerprints of one text. The first is that of the hashes themselves, each other one of hashes mixed from them."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(size, np.uint64)
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        total = len(words) - shingle + 1
    counts, digest = np.zeros((size, BITS), np.int64), xxhash.xxh64_intdigest
    for start in range(0, total, BLOCK):
        block = min(BLOCK, total - start)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(block)), np.uint64, block)
        for k in range(size):
            mixed = _mixed(hashes, k) if k else hashes
            counts[k] += np.unpackbits(mixed.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes, each from one of ``hashes``: multiplied and folded twice, in 64 bits."""
    out = hashes + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(factor)
    return out ^ (out >> np.uint64(32))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """The rows with a 64-bit fingerprint as a long; a null text has no words and so zero."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).astype(np.int64))

    return docs.withColumn(out, run(F.col(text)))


def band_layout(bands: int) -> tuple[int, int, int]:
    """Bits of a band, those of them under the Hamming code, and the code's parity bits."""
    width = BITS // bands
    parity = (width + 1).bit_length() - 1
    return width, 2**parity - 1, parity


def copy_masks(bands: int, distance: int) -> list[list[int]]:
    """By syndrome, the flips that lead to every anchor within covering radius plus the band's threshold.

    The first is the nearest anchor.
    """
    width, coded, parity = band_layout(bands)
    near = distance // bands
    out: list[list[tuple[int, int]]] = [[] for _ in range(2**parity)]
    free = {0: [0]}
    for weight in range(1, near + 1):
        free[weight] = [sum(1 << i for i in c) for c in combinations(range(coded, width), weight)]
    for weight in range(near + 2):
        over = max(0, weight - 1)
        for flips in combinations(range(coded), weight):
            syndrome = 0
            for i in flips:
                syndrome ^= i + 1
            mask = sum(1 << i for i in flips)
            for rest in range(near - over + 1):
                out[syndrome] += [(weight + rest, mask | more) for more in free[rest]]
    return [[mask for _, mask in sorted(each)] for each in out]


def at_anchors(prints: DataFrame, bands: int, distance: int, home: bool, source: str = "fp", keep: tuple[str, ...] = ("fp",)) -> DataFrame:
    """Fingerprints ``fp`` at their nearest anchor, or copied to every anchor that can hold a link.

    The anchors are those of ``source``; the columns of ``keep`` are given with each.
    """
    width, coded, parity = band_layout(bands)
    masks = copy_masks(bands, distance)
    choices = F.array(*[F.array(*[F.lit(m).cast("long") for m in (each[:1] if home else each)]) for each in masks])
    out = prints.select(*keep, F.col(source).alias("coded"), F.explode(F.array(*[F.lit(b) for b in range(bands)])).alias("band"))
    word = F.expr(f"shiftrightunsigned(coded, band * {width}) & {2**width - 1}L")
    syndrome = F.lit(0)
    for bit in range(parity):
        members = sum(1 << i for i in range(coded) if (i + 1) >> bit & 1)
        syndrome = syndrome + F.pmod(F.bit_count(word.bitwiseAND(F.lit(members).cast("long"))), F.lit(2)) * (1 << bit)
    out = out.select(*keep, "band", word.alias("word"), F.explode(F.element_at(choices, syndrome + 1)).alias("flips"))
    return out.select(*keep, F.expr(f"shiftleft(CAST(band AS BIGINT), {width}) + (word ^ flips)").alias("anchor"))


def linked(prints: DataFrame, distance: int = DISTANCE, bands: int = BANDS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at ``distance`` or fewer differing bits.

    ``prints`` has one row for each distinct fingerprint, so copies never meet here. A pair may be
    listed once for each band that finds it.
    """
    homes = at_anchors(prints, bands, distance, True).withColumnRenamed("fp", "a")
    copies = at_anchors(prints, bands, distance, False).withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    # Spark takes the copies to be no larger than the fingerprints they are made of, and would broadcast them.
    return homes.join(copies.hint("merge"), (homes["anchor"] == copies["anchor"]) & near).select("a", "b")


def _local_forest(frames):
    """A spanning forest of each task's edges, as edges to the smallest member."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ends = [(find(x), x) for x in list(parent)]
    yield pd.DataFrame([e for e in ends if e[0] != e[1]], columns=["a", "b"], dtype="int64")


def _digest(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, most: int = ONE_TASK) -> DataFrame:
    """Edges (a, b) turned into stars (root, node): root is the smallest node of the component.

    Where the forests of all tasks have ``most`` edges or fewer, one task joins them. Otherwise alternating
    large and small stars: every round halves the depth, and each node's rows are reduced
    to its smallest neighbour before they are joined. Rounds end in a reliable checkpoint; their joins are
    merged, since each broadcast would pass through the driver.
    """
    edges = cut_lineage(edges.mapInPandas(_local_forest, "a long, b long").distinct())
    if edges.limit(most + 1).count() <= most:
        stars = edges.coalesce(1).mapInPandas(_local_forest, "a long, b long")
        return cut_lineage(stars).select(F.col("a").alias("root"), F.col("b").alias("node"))
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("root").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("root"))
        met = large.join(down.hint("merge"), "b")
        small = met.select(F.col("root").alias("a"), "b").unionByName(
            met.where("a <> root").select(F.col("root").alias("a"), F.col("a").alias("b"))
        )
        edges = cut_lineage(small.distinct())
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("root"), F.col("b").alias("node"))


def near_duplicates(
    docs: DataFrame, order: str = "doc_id", text: str = "text", distance: int = DISTANCE, bands: int = BANDS, shingle: int = SHINGLE,
) -> DataFrame:
    """Every row's ``order`` value with its fingerprint and the smallest ``order`` of its component.

    Equal fingerprints are one node. Null and empty texts have fingerprint zero and link like any
    other. A component without any non-null ``order`` has a null ``component_id``.
    """
    prints = stored(fingerprints(docs.select(F.col(order).alias("doc_id"), F.col(text).alias("text")), "text", "fp", shingle).select("doc_id", "fp"))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies")))
    stars = components(linked(nodes.select("fp"), distance, bands))
    rooted = nodes.join(stars, nodes["fp"] == stars["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(firsts, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def expected_bits(similarity: float, bits: int, slack: float) -> int:
    """Bits that fingerprints of sets with this Jaccard similarity differ in, and ``slack`` standard deviations more."""
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(cosine) / math.pi
    return math.floor(share * bits + slack * math.sqrt(bits * share * (1 - share)))


def differing(a: str, b: str, size: int) -> Column:
    """Bits in which two sketches, columns ``a`` and ``b``, differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(size)), F.lit(0))


def agreeing(pairs: DataFrame, nodes: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs (a, b) whose whole sketches differ in no more bits than is expected of ``similarity``."""
    ends = [nodes.select(F.col("fp").alias(n), F.col("sketch").alias(f"{n}_sketch")) for n in ("a", "b")]
    whole = expected_bits(similarity, BITS * size, SLACK)
    return pairs.join(ends[0], "a").join(ends[1], "b").where(differing("a_sketch", "b_sketch", size) <= whole).select("a", "b")


def alike(nodes: DataFrame, similarity: float = SIMILARITY, size: int = SKETCH, bands: int = BANDS) -> DataFrame:
    """Pairs (a, b), a < b, of first fingerprints whose sketches differ in no more bits than is expected of ``similarity``.

    ``nodes`` has (fp, sketch), ``fp`` distinct. Two sketches are compared where one of their ``size * bands`` bands agrees up to one bit:
    each fingerprint of the sketch has anchors of its own. Pairs of less similar sets are found less often, those of
    more similar ones more often. First each node is compared with the smallest one of its own nearest anchors; then every
    two nodes that meet and aren't yet in one component are compared, whatever they are linked to already. So the pairs have the components of
    all links, and a group of many copies gives a few links for each of its members, not one for each pair.
    """
    def placed(rows: DataFrame, home: bool, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
        each = rows.select(F.col("fp").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in keep], F.posexplode("sketch").alias("k", "value"))
        names = (name, *[f"{name}_{c}" for c in keep])
        found = at_anchors(each, bands, bands, home, "value", (*names, "k"))
        return found.select(*names, (F.col("anchor") * size + F.col("k")).alias("anchor"))

    first = expected_bits(similarity, BITS, FIRST_SLACK)
    whole = expected_bits(similarity, BITS * size, SLACK)
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= first)
    homes = stored(placed(nodes, True, "b"))
    sizes = homes.groupBy("anchor").agg(F.min("b").alias("a"), F.count("*").alias("n"))
    settled = stored(agreeing(homes.join(sizes.where("n > 1"), "anchor").where(near).select("a", "b").distinct(), nodes, similarity, size))

    # Nodes of crowded anchors meet each other with their whole sketches, so that only links leave that join.
    width, _, parity = band_layout(bands)
    crowd = CROWD + CROWD * nodes.count() // 2 ** (width - parity)
    crowded = homes.join(sizes.where(F.col("n") >= crowd), "anchor").select(F.col("b").alias("fp"), F.lit(True).alias("c")).distinct()
    stars = components(settled).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(stars, "fp", "left").join(crowded, "fp", "left")
    rooted = stored(rooted.select("fp", "sketch", F.coalesce("root", "fp").alias("root"), F.coalesce("c", F.lit(False)).alias("c")))

    def meeting(rows: DataFrame, keep: tuple[str, ...], more: Column) -> DataFrame:
        ends = placed(rows, True, "a", keep), placed(rows, False, "b", keep)
        apart = near & (F.col("a_root") != F.col("b_root")) & more
        return ends[0].join(ends[1].hint("merge"), (ends[0]["anchor"] == ends[1]["anchor"]) & apart).select("a", "b").distinct()

    others = meeting(rooted, ("root", "c"), ~(F.col("a_c") & F.col("b_c")))
    inside = meeting(rooted.where("c"), ("root", "sketch"), differing("a_sketch", "b_sketch", size) <= whole)
    return settled.unionByName(agreeing(others, nodes, similarity, size)).unionByName(inside)


def keep_one(
    docs: DataFrame, order: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = ALIKE_SHINGLE, size: int = SKETCH,
) -> DataFrame:
    """One row of each group of documents that are alike: the smallest non-null ``order``, then the first written row.

    Alike are texts whose sets of ``shingle``-word shingles have about ``similarity`` or more in common, by their sketches.
    Equal first fingerprints are alike as they are; so null and empty texts are one group. All columns stay as they are.
    """
    key = free_name(docs, "_component_row")
    rows = keyed(docs, key)

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(t, shingle, size).astype(np.int64) for t in texts])

    # The smallest id decides; the written row decides among equal ids.
    place = F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("v"), F.col(key).alias("k"))
    prints = stored(rows.select(place.alias("o"), run(F.col(text)).alias("sketch")).select("o", "sketch"))
    nodes = stored(prints.groupBy(F.col("sketch")[0].alias("fp")).agg(F.min("o").alias("first"), F.min("sketch").alias("sketch")))
    stars = components(alike(nodes.select("fp", "sketch"), similarity, size))
    rooted = nodes.join(stars, nodes["fp"] == stars["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("best"))
    return rows.join(rooted.select(F.col("best.k").alias(key)), key, "left_semi").select(*docs.columns)


@query("op3_anchor_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents; tested against comparing all pairs."""
    return near_duplicates(table(spark, sf_dir, "documents"))
