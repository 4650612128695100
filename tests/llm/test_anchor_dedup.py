from __future__ import annotations

import random

import pytest
import xxhash
from fixtures import awkward, documents, with_clashes
from pyspark.sql import functions as F

from docketflow.llm import anchor_dedup as op


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Component of each index by comparing all pairs."""
    found = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4 and found[i] != found[j]:
                old, new = found[i], found[j]
                found = [new if f == old else f for f in found]
    return found


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    classes = plain_classes(prints)
    least = {}
    for (i, _), c in zip(rows, classes):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, classes)), key=str)


def test_awkward_rows(spark):
    rows = awkward()
    got = op.near_duplicates(with_clashes(documents(spark, rows))).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_near_copies(spark):
    random.seed(5)
    base = [" ".join(f"w{random.randrange(5000)}" for _ in range(400)) for _ in range(6)]
    rows = []
    for n in range(150):
        words = base[n % 6].split()
        if n % 3:
            words[random.randrange(400)] = f"v{n}"
        rows.append((n, " ".join(words)))
    got = sorted(map(tuple, op.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == expected(rows)


def test_empty(spark):
    assert op.near_duplicates(documents(spark, [], 1)).count() == 0


@pytest.mark.parametrize("bands", [2, 3])
def test_links_are_complete(spark, bands):
    random.seed(bands)
    values = {random.getrandbits(64) for _ in range(150)}
    for v in list(values):
        for k in (1, 2, 3, 4, 5):
            values.add(v ^ sum(1 << b for b in random.sample(range(64), k)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {tuple(r) for r in op.linked(frame, 4, bands).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(-40, 200)] + [(1000, k) for k in range(1001, 1060)] + [(1059, 1060)]
    random.seed(1)
    random.shuffle(chain)
    frame = spark.createDataFrame(chain, "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in op.components(frame).collect()}
    assert got == {**{i: -40 for i in range(-39, 201)}, **{k: 1000 for k in range(1001, 1061)}}


def plain_alike(texts, strict):
    """Classes of texts by comparing all sketches; ``strict`` asks for a band that agrees up to one bit, as anchors promise."""
    sketches = [[int(v) for v in op.sketch(t, op.ALIKE_SHINGLE, op.SKETCH)] for t in texts]
    first, whole = op.expected_bits(op.SIMILARITY, 64, op.FIRST_SLACK), op.expected_bits(op.SIMILARITY, 64 * op.SKETCH, op.SLACK)
    found = list(range(len(texts)))
    for i, a in enumerate(sketches):
        for j in range(i):
            b = sketches[j]
            apart = [x ^ y for x, y in zip(a, b)]
            near = apart[0].bit_count() <= first and sum(x.bit_count() for x in apart) <= whole
            banded = any((x >> 21 * k & 0x1FFFFF).bit_count() <= 1 for x in apart for k in range(3))
            if (not apart[0] or near and (banded or not strict)) and found[i] != found[j]:
                old, new = found[i], found[j]
                found = [new if f == old else f for f in found]
    return found


def test_one_row_of_each_class_stays(spark):
    rows = awkward()
    docs = with_clashes(documents(spark, rows)).withColumn("_component_row", F.lit("clash")).withColumn("_metadata", F.lit("clash"))
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(plain_alike([t for _, t in rows], True))) == len(set(plain_alike([t for _, t in rows], False)))
    assert {(r["_component_row"], r["_metadata"]) for r in kept.collect()} == {("clash", "clash")}
    assert [r["text"] for r in kept.collect()].count("one two three four five six") == 1


def edited(words, similarity, tag):
    """A copy with words replaced at random places until the sets of shingles have no more than ``similarity`` in common."""
    own = set(zip(*(words[k:] for k in range(5))))
    out, n = list(words), 0
    while True:
        other = set(zip(*(out[k:] for k in range(5))))
        if len(own & other) / len(own | other) <= similarity:
            return out
        out[random.randrange(len(out))] = f"{tag}x{n}"
        n += 1


def test_recall_by_similarity(spark):
    """Each pair of a text and its edited copy is one group in nine of ten cases or more; other texts stay alone."""
    random.seed(6)
    rows, wanted = [], {}
    for similarity in (0.8, 0.85, 0.9, 0.95):
        for n in range(120):
            words = [f"w{random.randrange(4000)}" for _ in range(random.choice([150, 400, 900]))]
            key = len(rows)
            rows += [(key, " ".join(words)), (key + 1, " ".join(edited(words, similarity, f"v{key}")))]
            wanted.setdefault(similarity, []).append(key)
    rows += [(5000 + n, " ".join(f"w{random.randrange(4000)}" for _ in range(300))) for n in range(300)]
    kept = {r["doc_id"] for r in op.keep_one(documents(spark, rows)).collect()}
    caught = {s: sum(k + 1 not in kept for k in keys) / len(keys) for s, keys in wanted.items()}
    assert all(k in kept for keys in wanted.values() for k in keys) and all(i in kept for i, _ in rows[-300:])
    assert caught[0.95] >= 0.99 and caught[0.9] >= 0.98 and caught[0.85] >= 0.9 and caught[0.8] >= 0.75, caught
    strict = plain_alike([t for _, t in rows], True)
    loose = plain_alike([t for _, t in rows], False)
    assert len(set(loose)) <= len(kept) <= len(set(strict))


def test_large_group_of_near_copies(spark):
    random.seed(7)
    words = [f"w{random.randrange(4000)}" for _ in range(300)]
    rows = [(n, " ".join(words[:n % 300] + [f"v{n}"] + words[n % 300:])) for n in range(800)]
    assert [r["doc_id"] for r in op.keep_one(documents(spark, rows)).collect()] == [0]


def test_no_link_is_lost_to_a_leader(spark):
    """Members that a leader has settled keep their links to others: the components are those of all links."""
    random.seed(8)
    first, whole = op.expected_bits(op.SIMILARITY, 64, op.FIRST_SLACK), op.expected_bits(op.SIMILARITY, 64 * op.SKETCH, op.SLACK)
    sketches = {}
    for _ in range(6):
        base = [random.getrandbits(64) for _ in range(op.SKETCH)]
        for _ in range(70):
            own = list(base)
            for bit in random.sample(range(64 * op.SKETCH), random.randrange(24, 44)):
                own[bit // 64] ^= 1 << bit % 64
            own = [v - (1 << 64) if v >> 63 else v for v in own]
            sketches[own[0]] = own
    nodes = spark.createDataFrame(list(sketches.items()), "fp long, sketch array<long>")
    found = op.alike(nodes).collect()
    root = {fp: fp for fp in sketches}
    for a, b in found:
        old, new = root[b], root[a]
        root = {k: new if v == old else v for k, v in root.items()}

    def apart(a, b):
        return [(x ^ y) & (2**64 - 1) for x, y in zip(sketches[a], sketches[b])]

    def is_near(x):
        return x[0].bit_count() <= first and sum(v.bit_count() for v in x) <= whole

    assert all(a < b and is_near(apart(a, b)) for a, b in found)
    lost = 0
    for a in sketches:
        for b in sketches:
            x = apart(a, b)
            if a < b and is_near(x) and any((v >> 21 * k & 0x1FFFFF).bit_count() <= 1 for v in x for k in range(3)):
                lost += root[a] != root[b]
    assert not lost


@pytest.mark.parametrize("most", [0, 20, 1000])
def test_components_by_rounds_and_by_one_task(spark, most):
    random.seed(9)
    edges = [tuple(sorted(random.sample(range(-300, 300), 2))) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1050)]
    least = {n: n for e in edges for n in e}
    for a, b in edges:
        new, old = sorted((least[a], least[b]))
        least = {k: new if v == old else v for k, v in least.items()}
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r["node"]: r["root"] for r in op.components(frame, most).collect()}
    assert got == {n: r for n, r in least.items() if n != r}


def test_exploded_copies_are_never_broadcast(spark, tmp_path):
    """Their size is taken for that of the rows before the explode, so a broadcast may hold many times what it is planned for."""
    path = str(tmp_path / "nodes")
    spark.range(50).select((F.col("id") * 0x9E3779B9).alias("fp"), F.array([F.col("id") * k for k in (3, 5, 7, 11, 13)]).alias("sketch")).write.parquet(path)
    nodes = spark.read.parquet(path)
    plan = op.linked(nodes.select("fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
