"""Quality rules by hashed n-gram log-likelihood ratios, in DataFrame functions only.

Two multinomials over hashed n-grams are counted: the raw corpus (all documents) and the trusted
target (documents labelled good and not toxic). The n-grams are words, and pairs of neighbouring
word forms (letters, capitals and digits shortened to one sign each, with a mark where the words
are equal). A document's score is the mean log ratio of its n-grams, with the target smoothed by the
raw distribution at ``PRIOR`` times its own weight. So a score is at least -ln((1 + PRIOR) / PRIOR) at any
corpus size, and every document is judged by the same threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm.registry import query, table
from docketflow.llm.rows import bound, free_name, key_filter, may_hold
from docketflow.session import stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Buckets of each n-gram order; they bound the table of ratios.
BUCKETS = 1 << 17
PRIOR = 2.0
THRESHOLD = -0.06
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def forms_of(text: Column) -> Column:
    """The text with each run of capitals, other letters and digits as one sign."""
    out = F.regexp_replace(text, r"\p{Lu}+", "A")
    # No other capital is left, so these are all letters and marks but A.
    out = F.regexp_replace(out, r"[a-z\p{Ll}\p{Lo}\p{Lm}\p{Lt}\p{M}]+", "a")
    return F.regexp_replace(out, r"\p{N}+", "0")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def neighbours(values: Column, step: int, of) -> Column:
    """``of`` each value and the one ``step`` places on."""
    return F.zip_with(shifted(values, 0, step), shifted(values, step, step), of)


def shifted(values: Column, start: int, less: int) -> Column:
    """``less`` values fewer, from place ``start`` on."""
    return F.slice(values, 1 + start, F.greatest(F.size(values) - less, F.lit(0)))


def places_of(words: Column, forms: Column) -> Column:
    """A struct for each word: ``word`` and ``form``, and those of the next word, null for the last."""
    return F.arrays_zip(
        words.alias("word"), forms.alias("form"), shifted(words, 1, 1).alias("next_word"), shifted(forms, 1, 1).alias("next_form"),
    )


def word_bucket(word: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a word, below ``buckets``, a power of two; null for none."""
    return F.when(word.isNotNull(), F.xxhash64(word).bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int"))


def pair_bucket(word: Column, form: Column, next_word: Column, next_form: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a pair of forms, from ``buckets`` on; null where there is no next one."""
    pair = F.xxhash64(F.xxhash64(form), F.xxhash64(next_form))
    mixed = F.when(word == next_word, F.bitwise_not(pair)).otherwise(pair)
    return F.when(next_word.isNotNull(), (mixed.bitwiseAND(F.lit(buckets - 1).cast("long")) + buckets).cast("int"))


def buckets_of(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of a text's n-grams as one array: words, then pairs of forms."""
    def grams(places: Column) -> Column:
        single = F.transform(places, lambda p: word_bucket(p["word"], buckets))
        return F.concat(single, F.transform(
            shifted(places, 0, 1), lambda p: pair_bucket(p["word"], p["form"], p["next_word"], p["next_form"], buckets),
        ))

    return bound(places_of(words_of(text), words_of(forms_of(text))), grams)


def by_word(rows: DataFrame, words: str, forms: str, buckets: int = BUCKETS) -> DataFrame:
    """A row for each word of each row, one for a row without words, with its n-grams ``single`` and ``pair``.

    Instead of ``words`` and ``forms`` there is ``word``; other columns stay. Rows are hashed in generated code,
    which lambdas over arrays are not.
    """
    keep = [c for c in rows.columns if c not in (words, forms)]
    each = rows.select(*keep, F.inline_outer(places_of(F.col(words), F.col(forms))).alias("word", "form", "next_word", "next_form"))
    return each.select(
        *keep, "word", word_bucket(F.col("word"), buckets).alias("single"),
        pair_bucket(*[F.col(c) for c in ("word", "form", "next_word", "next_form")], buckets).alias("pair"),
    )


def log_ratios(rows: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> Column:
    """The ratio of every bucket as one array of 2 * ``buckets`` numbers.

    ``rows`` has (text, raw, target): how often a text counts for the raw corpus and for the target. Both counts
    cover every n-gram of every row, taken once; a task sends one row for each bucket at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = rows.select("raw", "target", words_of(text).alias("words"), words_of(forms_of(text)).alias("forms"))
    grams = by_word(words, "words", "forms", buckets).select("raw", "target", F.explode(F.array("single", "pair")).alias("bucket"))
    counts = grams.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("raw").alias("r"), F.sum("target").alias("t"))

    spark = rows.sparkSession
    every = spark.range(0, 2 * buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    table_ = stored(every.join(counts, "bucket", "left").na.fill(0))
    order = F.col("bucket") >= buckets
    totals = table_.groupBy(order.alias("pair")).agg(F.sum("r").alias("all_r"), F.sum("t").alias("all_t"))
    share = (F.col("r") + 1) / (F.col("all_r") + buckets)
    mixed = (F.when(F.col("all_t") > 0, F.col("t") / F.col("all_t")).otherwise(share) + prior * share) / (1 + prior)
    rated = table_.withColumn("pair", order).join(totals, "pair").select("bucket", F.ln(mixed / share).alias("v"))
    found = F.array_sort(F.collect_list(F.struct("bucket", "v")))
    return rated.agg(F.transform(found, lambda r: r["v"]).alias("ratios")).scalar()


def joined(hashes: Column, step: int) -> Column:
    """Hashes of twice as many words from hashes of ``step`` words."""
    return neighbours(hashes, step, lambda a, b: F.xxhash64(a, b))


def with_repeated_words(rows: DataFrame, words: str, out: str, window: int = WINDOW) -> DataFrame:
    """The rows with the number of words inside windows that occur twice or more, first occurrences included.

    ``words`` is a column of lists of words, ``window`` a power of two from 4 on.
    """
    none = F.lit(0).cast("long")

    def covered(starts: Column) -> Column:
        first = F.struct(none.alias("n"), F.lit(0).alias("end"))

        def step(acc: Column, s: Column) -> Column:
            new = s + window - F.greatest(s, acc["end"])
            return F.struct((acc["n"] + new).alias("n"), (s + window).alias("end"))

        return F.aggregate(starts, first, step)["n"]

    def starts_of(ordered: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            # Out of range gives null, which is not equal to anything.
            after = F.get(ordered, i + 1)["h"] == x["h"]
            before = F.when(i > 0, F.get(ordered, i - 1)["h"] == x["h"])
            return F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, twice), lambda x: x["i"]))

    def doubled(values: Column, step: int, of) -> Column:
        if step >= window:
            return values
        return doubled(bound(values, lambda v: neighbours(v, step, of)), 2 * step, of)

    def exact() -> Column:
        texts = doubled(F.col(words), 1, lambda a, b: F.concat(a, F.lit(" "), b))
        places = bound(texts, lambda t: F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        return bound(places, lambda o: bound(starts_of(o), covered))

    half, number = window // 2, free_name(rows, "_hashes")
    hashed, step = rows.withColumn(number, hashes_of(F.col(words))), 1
    while step < half:
        hashed, step = hashed.withColumn(number, joined(F.col(number), step)), 2 * step
    # Each half window inside the later one of two equal windows has come before, and equal windows have equal hashes;
    # so few rows need the hashes of whole windows, and only those with an equal one are looked at in full.
    halves = F.size(number) - F.size(F.array_distinct(number)) > half
    wholes = bound(doubled(F.col(number), half, lambda a, b: F.xxhash64(a, b)), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return hashed.withColumn(out, F.when(halves, F.when(wholes, exact()).otherwise(none)).otherwise(none)).drop(number)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def scored(docs: DataFrame, ratios: Column, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row with its counts, score and verdict; a row's score is the mean ratio of its n-grams, zero without any."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Equal rows stay apart by a number that needs no sort; a task sends one row for each of its documents.
    counted = source.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"), words_of(F.col("text")).alias("words"), words_of(forms_of(F.col("text"))).alias("forms"),
    )
    # The ratios are one value of fixed size, named once so that the optimizer puts it into the expression.
    each = by_word(with_repeated_words(counted, "words", "n_repeat_words"), "words", "forms").withColumn("ratios", ratios)
    ratio = sum((F.coalesce(F.element_at("ratios", F.col(c) + 1), F.lit(0.0)) for c in ("single", "pair")), F.lit(0.0))
    out = each.groupBy("row", "doc_id").agg(
        F.count("word").alias("n_words"), F.coalesce(F.sum(F.char_length("word").cast("long")), F.lit(0).cast("long")).alias("word_chars"),
        *[F.any_value(c).alias(c) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")],
        F.sum(ratio).alias("total"), (F.count("single") + F.count("pair")).alias("n_grams"),
    )
    out = out.withColumn("score", F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams")).otherwise(F.lit(0.0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("score") >= threshold)).alias("kept"), F.round("score", 9).alias("score"),
    )


def judged(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with its counts, score and verdict, by the rows of ``target`` with the same column ``text``.

    A null or empty text has no words, fails the base rules and scores zero. Without any target row
    all ratios are zero and only the base rules decide. Repeated rows each get the same result.
    """
    def rows(df: DataFrame, raw: int) -> DataFrame:
        return df.select(F.col(text).alias("text"), F.lit(raw).alias("raw"), F.lit(1 - raw).alias("target"))

    return scored(docs, log_ratios(rows(docs, 1).unionByName(rows(target, 0))), id_column, text, threshold)


def good_ids(labels: DataFrame) -> DataFrame:
    """The ids labelled good and not toxic; a label repeated with another verdict counts as not good."""
    return stored(labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0").select("doc_id"))


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with the ids of :func:`good_ids`."""
    good = good_ids(labels)
    near = docs.where(F.col("doc_id").isNotNull() & may_hold(key_filter(good, "doc_id"), F.col("doc_id")))
    # Labels grow with the corpus: a merge join at every size.
    return near.join(good.hint("merge"), "doc_id", "left_semi")


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, raw, target) of every row for :func:`log_ratios`: the rows of :func:`trusted` count for both, so their n-grams are taken once."""
    good = good_ids(labels)
    near = F.coalesce(may_hold(key_filter(good, "doc_id"), F.col("doc_id")), F.lit(False)) & F.col("doc_id").isNotNull()
    met = docs.where(near).select("doc_id", "text").join(good.withColumn("good", F.lit(1)).hint("merge"), "doc_id", "left")
    rest = docs.where(~near).select("text", F.lit(1).alias("raw"), F.lit(0).alias("target"))
    return rest.unionByName(met.select("text", F.lit(1).alias("raw"), F.coalesce("good", F.lit(0)).alias("target")))


@query("op10_ngram_ratio")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document; tested against a plain version."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, log_ratios(marked(docs, table(spark, sf_dir, "labels"))))
