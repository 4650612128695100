"""Spelling variants by pivotal grams.

A word's bigrams are put in one global order, rare ones first. Its prefix are the three first (and what else is equal to
the third): among three bigrams two never overlap. Of the prefix a dynamic program chooses two disjoint
bigrams of least total frequency, the pivots. One edit harms at most one of the two, so of two words at one edit
the one whose prefix ends earlier in the order has a pivot that lies in the other's prefix. Where the edit lies says where:
behind both pivots, and all up to the end of the second stays in place; before both, and all from the first one on keeps its
distance from the end; between them, and both holds for what is outside. So pivots are looked up among prefix grams not by
the gram alone but with all of the word that such an edit can't reach, by its hash: the gram alone met a thousand million pairs
of half a million words here. Of the pairs found, those whose letters differ too much go, the others are verified.

The order needs no more than a fixed number of frequencies, of buckets of bigrams, whatever the alphabet is.

Counting: a null text has no words; a null id is written as nothing. Very long texts are counted in blocks of whole words, each task
sends partial counts. Repeated rows count again. Ties between forms go to the smaller word in code-point order. An
empty table has no words. Other columns of the input don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm.registry import query, table
from docketflow.llm.rows import keyed
from docketflow.session import stored

MIN_CHARS = 6
MIN_COUNT = 5
#: A form is this many times as frequent as the word, so chains of forms end after a logarithm of the counts.
FACTOR = 5
#: One in so many occurrences, by their hash, loses a character.
DAMAGED = 199
GRAM = 2
EDITS = 1
PREFIX = GRAM * EDITS + 1
#: Buckets of bigrams whose frequencies give the order.
BUCKETS = 1 << 16
#: Words that a task counts before it sends them on, and letters it takes at once.
HELD = 1 << 19
BLOCK = 1 << 22

#: A-Z in lower case, other letters as they are, everything else a space; one byte for a character below 256.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256)
)

#: Where the edit lies: behind both pivots, before both, between them with the first or the second one whole.
BEHIND, BEFORE, FIRST_WHOLE, SECOND_WHOLE = range(4)
#: Rows of the index that a task sends at once.
SENT = 1 << 18


def runs_of(text: str) -> Iterator[list[bytes]]:
    """Lower-cased maximal letter runs as Latin-1 bytes, in blocks of whole runs."""
    letters = text.encode("latin-1", "replace").translate(_LETTERS)
    start = 0
    while len(letters) - start > BLOCK:
        at = letters.find(b" ", start + BLOCK)
        if at < 0:
            break
        yield letters[start:at].split()
        start = at
    yield letters[start:].split()


def damaged(run: bytes, prefix: int, every: int) -> bytes:
    """The run, without one character where its hash says so; ``prefix`` is the CRC of what stands before it."""
    code = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if code % every:
        return run
    at = code % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = DAMAGED,
) -> DataFrame:
    """Words (word, n) of at least ``min_chars`` characters and ``min_count`` occurrences in all texts."""

    def run(batches):
        held: Counter[bytes] = Counter()

        def sent():
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )
            held.clear()
            return out

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for runs in runs_of(value.as_py() or ""):
                    for word, n in Counter(runs).items():
                        if len(word) >= min_chars:
                            word = damaged(word, prefix, every)
                            if len(word) >= min_chars:
                                held[word] += n
                    if len(held) >= HELD:
                        yield sent()
        if held:
            yield sent()

    counts = docs.select(id_column, text).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def gram_code(word, place):
    """A bigram as one number: its two code points."""
    first, second = (F.ascii(F.substring(word, place + k, 1)).cast("long") for k in (1, 2))
    return F.shiftleft(first, 21) + second


def frequencies(words: DataFrame) -> np.ndarray:
    """Bigrams of all words by bucket; as many numbers as there are buckets, at any size."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.char_length("word") - 2), lambda i: gram_code(F.col("word"), i))).alias("gram"))
    rows = grams.groupBy(F.pmod("gram", F.lit(BUCKETS)).alias("bucket")).count().collect()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, count in rows:
        out[bucket] = count
    return out


def pivots_of(prefix: list[tuple[int, int, int]]) -> set[int]:
    """Places of ``EDITS + 1`` disjoint grams of least total frequency among (frequency, gram, place).

    ``best[k][i]`` is the least cost of k disjoint grams among the first i by place.
    """
    grams = sorted((place, frequency) for frequency, _, place in prefix)
    best: list[list[tuple[float, tuple[int, ...]]]] = [[(0, ())] * (len(grams) + 1)]
    for k in range(1, EDITS + 2):
        row: list[tuple[float, tuple[int, ...]]] = [(math.inf, ())]
        for i, (place, frequency) in enumerate(grams, 1):
            free = i - 1
            while free and grams[free - 1][0] > place - GRAM:
                free -= 1
            cost, chosen = best[k - 1][free]
            row.append(min(row[-1], (cost + frequency, (*chosen, place))))
        best.append(row)
    return set(best[-1][-1][1])


def ends_of(word: str) -> tuple[list[int], list[int]]:
    """Hashes of what stands before and of what stands from each place on; equal texts have equal ones."""
    signs = [c.encode("utf-8", "surrogatepass") for c in word]
    heads, tails = [0], [0]
    for sign in signs:
        heads.append(zlib.crc32(sign, heads[-1]))
    for sign in reversed(signs):
        tails.append(zlib.crc32(sign, tails[-1]))
    return heads, tails[::-1]


def keys_of(word: str, counts: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """What the word is looked up by, by its pivots, and what it is found by, by the grams of its prefix: (case, head, tail)."""
    codes = [ord(c) for c in word]
    order = sorted((int(counts[g % BUCKETS]), g, i) for i, g in enumerate((a << 21) + b for a, b in zip(codes, codes[1:])))
    last = order[PREFIX - 1][:2]
    prefix = [x for x in order if x[:2] <= last]
    first, second = sorted(pivots_of(prefix))
    heads, tails = ends_of(word)
    asked = [
        (BEHIND, heads[second + GRAM], 0), (BEFORE, 0, tails[first]),
        (FIRST_WHOLE, heads[first + GRAM], tails[second + GRAM]), (SECOND_WHOLE, heads[first], tails[second]),
    ]
    held = []
    for _, _, place in prefix:
        held += [(BEHIND, heads[place + GRAM], 0), (BEFORE, 0, tails[place])]
        held += [(FIRST_WHOLE, heads[place + GRAM], tail) for tail in tails[place + GRAM :]]
        held += [(SECOND_WHOLE, head, tails[place]) for head in heads[: place + 1]]
    return asked, held


def letters_of(word: str) -> int:
    """A bit for every sign, by its code, set where the sign comes an odd number of times; one edit turns at most two."""
    out = 0
    for sign in word:
        out ^= 1 << (ord(sign) & 63)
    return out - (1 << 64) if out >> 63 else out


def marked(words: DataFrame) -> DataFrame:
    """(edit, key, id, size, letters, pivot): rows of pivots and of prefix grams of the words (id, word)."""
    counts = frequencies(words)

    def run(batches):
        def sent():
            edits, head, tail = (np.array(c, np.uint64) for c in zip(*keys))
            columns = [edits.astype(np.int8), ((head << np.uint64(32)) | tail).astype(np.int64), np.array(ids), np.array(sizes, np.int32), np.array(letters), np.array(pivot)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["edit", "key", "id", "size", "letters", "pivot"])

        keys, ids, sizes, letters, pivot = [], [], [], [], []
        for batch in batches:
            for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                signs = letters_of(word)
                for asking, rows in zip((True, False), keys_of(word, counts)):
                    keys += rows
                    letters += [signs] * len(rows)
                    ids += [number] * len(rows)
                    sizes += [len(word)] * len(rows)
                    pivot += [asking] * len(rows)
                if len(keys) >= SENT:
                    yield sent()
                    keys, ids, sizes, letters, pivot = [], [], [], [], []
        if keys:
            yield sent()

    return words.select("id", "word").mapInArrow(run, "edit byte, key long, id long, size int, letters long, pivot boolean")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words (word, n) at exactly one edit, once in each direction: word, n, near, near_n.

    Words are distinct and have at least four characters.
    """
    rows = keyed(words.select("word", "n"), "id")
    index = stored(marked(rows))
    sizes = F.array(*[F.struct((F.col("size") + d).alias("size"), F.lit(1 if d else 2).alias("turned")) for d in (-1, 0, 1)])
    pivots = index.where("pivot").select("edit", "key", F.explode(sizes).alias("other"), F.col("id").alias("a"), F.col("letters").alias("a_letters"))
    pivots = pivots.select("edit", "key", "other.size", "other.turned", "a", "a_letters")
    grams = index.where("NOT pivot").select("edit", "key", "size", F.col("id").alias("b"), F.col("letters").alias("b_letters"))
    met = pivots.join(grams, ["edit", "key", "size"]).where("a <> b AND bit_count(a_letters ^ b_letters) <= turned")
    pairs = met.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    for end in ("low", "high"):
        pairs = pairs.join(rows.select(F.col("id").alias(end), F.struct("word", "n").alias(f"{end}_word")), end)
    verified = pairs.where(F.levenshtein("low_word.word", "high_word.word", 1) == 1)
    both = F.array(*[F.struct(F.col(f"{x}_word").alias("own"), F.col(f"{y}_word").alias("near")) for x, y in (("low", "high"), ("high", "low"))])
    return verified.select(F.explode(both).alias("pair")).select(
        F.col("pair.own.word").alias("word"), F.col("pair.own.n").alias("n"), F.col("pair.near.word").alias("near"), F.col("pair.near.n").alias("near_n"),
    )


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): the end of each word's chain in (word, form).

    A form is ``FACTOR`` times as frequent as its word, so with counts up to ``most`` no chain is longer than their
    logarithm. Each round doubles the steps that are behind a word.
    """
    longest = max(1, math.ceil(math.log(max(most, FACTOR), FACTOR)))
    out = stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(longest + 1))):
        onward = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = stored(out.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return out


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Each word (word, n) with its number of near words, its form, the form's count, and its root."""
    pairs = near_pairs(words)
    first = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("word")))
    near = stored(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("first")))
    joined = words.join(near, "word", "left")
    chosen = -F.col("first.order") >= factor * F.col("n")
    out = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("first.word")).alias("form"), F.when(chosen, -F.col("first.order")).alias("form_n"),
    ))
    most = out.agg(F.max("n")).first()[0] or 1
    ends = roots(out.where("form IS NOT NULL"), most)
    return out.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: CRC-32 byte by byte over its table, which follows from the polynomial; characters below 256 have one or two bytes.
_SQL = """WITH RECURSIVE steps AS (SELECT i AS entry, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT entry, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY entry) AS tab FROM steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch:
    CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::UBIGINT] ELSE [195::UBIGINT, (unicode(ch) - 64)::UBIGINT] END))),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h FROM lowered, crc WHERE length(run) >= 6),
results AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS best FROM pairs GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 5 * w.n THEN best[2] END AS form,
  (CASE WHEN -best[1] >= 5 * w.n THEN -best[1] END)::BIGINT AS form_n FROM words w LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root FROM formed f JOIN chain c USING (word) JOIN formed e ON c.at = e.word WHERE e.form IS NULL"""


@query("op12_spelling_variants", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(stored(word_counts(table(spark, sf_dir, "documents"))))
