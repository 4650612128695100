"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

The index holds (term, text, position) rows, stored and shared by all phrases. A phrase is found by its rarest
terms: the postings of the rarest give the possible starts, and those whose second rarest term stands
at its own offset stay. What is left is compared word by word with the text. Postings are kept for the
terms that some phrase is looked up by; which these are follows from counts over the whole corpus.
Texts are keyed by digest, so copies share their postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm.registry import query, table
from docketflow.llm.rows import bound, key_filter, lower_ascii, may_hold
from docketflow.session import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lowered.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def raw_words_of(text: Column) -> Column:
    """The words of a text as they are written; :func:`lower_ascii` of each is the word."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RAW_WORD), F.lit(0))


def digest_of(text: Column) -> Column:
    """16 bytes of the SHA-256 of a text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def phrases_of(items: DataFrame, id_column: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, phrase, n): every window of an item's words, or all of them where there are fewer."""
    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (window - 1), F.lit(1)))
        return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.slice(words, i, window)))

    windows = items.select(F.col(id_column).alias("item_id"), F.explode(bound(words_of(F.col(text)), cut)).alias("w"))
    return windows.select("item_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("n")).distinct()


def anchors_of(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, n, term, offset, term2, offset2): the two rarest terms of each phrase in the corpus.

    A term that no text holds makes its phrase impossible, and the phrase is left out. One-word
    phrases have their word twice.
    """
    distinct = phrases.select("phrase", "n").distinct()
    spelled = distinct.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    vocabulary = stored(spelled.select("term").distinct())
    spoken = texts.select(F.explode(raw_words_of(F.col("text"))).alias("term")).select(lower_ascii(F.col("term")).alias("term"))
    held = spoken.where(may_hold(key_filter(vocabulary, "term"), F.col("term")))
    counts = vocabulary.join(held.groupBy("term").agg(F.count("*").alias("freq")), "term", "left").na.fill(0, ["freq"])
    ranked = spelled.join(counts, "term").groupBy("phrase", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "term", "offset"))).alias("r"))
    second = F.element_at("r", F.least(F.lit(2), F.size("r")))
    return ranked.where(F.col("r")[0]["freq"] > 0).select(
        "phrase", "n", F.col("r")[0]["term"].alias("term"), F.col("r")[0]["offset"].alias("offset"),
        second["term"].alias("term2"), second["offset"].alias("offset2"),
    )


def postings_of(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, digest, position) of the given terms in all texts; copies of a text are listed once."""
    spelled = texts.select(digest_of(F.col("text")).alias("digest"), F.posexplode(raw_words_of(F.col("text"))).alias("position", "term"))
    near = spelled.withColumn("term", lower_ascii(F.col("term"))).where(may_hold(key_filter(terms, "term"), F.col("term")))
    return near.groupBy("term", "digest", "position").agg(F.lit(1).alias("one")).drop("one").join(terms, "term", "left_semi")


class Index:
    """Stored postings of a corpus for a set of phrases."""

    def __init__(self, texts: DataFrame, phrases: DataFrame):
        self.texts = texts
        self.anchors = stored(anchors_of(texts, phrases))
        terms = stored(self.anchors.select("term").unionByName(self.anchors.select(F.col("term2").alias("term"))).distinct())
        self.postings = stored(postings_of(texts, terms))

    def starts(self) -> DataFrame:
        """Where the rarest term puts the start of a phrase, with the place its second term must have."""
        found = self.postings.join(self.anchors, "term").withColumn("start", F.col("position") - F.col("offset"))
        return found.where("start >= 0").select("digest", "phrase", "n", "start", "term2", (F.col("start") + F.col("offset2")).alias("position2"))

    def candidates(self) -> DataFrame:
        """Starts at which the two rarest terms of a phrase stand at their offsets."""
        second = self.postings.select(F.col("term").alias("term2"), "digest", F.col("position").alias("position2"))
        return self.starts().join(second, ["term2", "digest", "position2"], "left_semi").select("digest", "phrase", "n", "start")

    def proximity(self, slack: int) -> DataFrame:
        """Pairs of a phrase's two rarest terms whose distance is off by at most ``slack`` words.

        Positions meet by blocks of slack + 1 words, so each looks at three blocks and not at the whole text.
        """
        width = slack + 1
        block = F.floor(F.col("position2") / width)
        first = self.starts().withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
        second = self.postings.select(F.col("term").alias("term2"), "digest", F.col("position").alias("found"), F.floor(F.col("position") / width).alias("block"))
        gap = (F.col("found") - F.col("position2")).alias("gap")
        return first.join(second, ["term2", "digest", "block"]).select("digest", "phrase", "n", "start", gap).where(F.abs("gap") <= slack)

    def exact(self) -> DataFrame:
        """(digest, hits): for each text with a match the true ones, as (start, n, phrase).

        One row for each text with candidates is joined with that text; copies of a text repeat the check.
        """
        lists = stored(self.candidates().groupBy("digest").agg(F.collect_list(F.struct("start", "n", "phrase")).alias("found")))
        near = self.texts.select("text", digest_of(F.col("text")).alias("digest")).where(may_hold(key_filter(lists, "digest"), F.col("digest")))

        def true_ones(words: Column) -> Column:
            return F.filter("found", lambda c: F.array_join(F.slice(words, c["start"] + 1, c["n"]), " ") == c["phrase"])

        checked = near.join(lists, "digest").select("digest", bound(words_of(F.col("text")), true_ones).alias("hits"))
        return checked.where(F.size("hits") > 0)


def words_inside(hits: Column) -> Column:
    """Number of different positions that the hits cover."""
    def step(acc: Column, hit: Column) -> Column:
        end = hit["start"] + hit["n"]
        new = F.greatest(end - F.greatest(hit["start"], acc["end"]), F.lit(0))
        return F.struct((acc["covered"] + new).alias("covered"), F.greatest(end, acc["end"]).alias("end"))

    none = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(hits), none, step)["covered"]


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row with its words, those inside an occurrence of an item's window, and the items met.

    Null and empty texts have no words and meet nothing; items without words have no window. Null
    item ids are not listed. Repeated rows get equal results; items with equal texts are all listed.
    """
    texts = docs.select(F.col(text).alias("text"))
    phrases = stored(phrases_of(items, window=window))
    exact = stored(Index(texts, phrases).exact().select("digest", words_inside(F.col("hits")).alias("n_hit"), F.expr("array_distinct(hits.phrase)").alias("phrases")))
    covered = exact.groupBy("digest").agg(F.max("n_hit").alias("n_hit"))
    met = exact.select("digest", F.explode("phrases").alias("phrase")).distinct()
    listed = met.join(phrases.select("phrase", "item_id"), "phrase").select("digest", F.col("item_id").cast("string").alias("item")).where("item IS NOT NULL").distinct()
    named = listed.groupBy("digest").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    found = covered.join(named, "digest", "left")
    rows = docs.select(
        F.col(id_column).alias("doc_id"), digest_of(F.col(text)).alias("digest"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(RAW_WORD)).cast("long").alias("n_words"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(found, "digest", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows whose text holds no window of any item, with all their columns."""
    phrases = stored(phrases_of(items, window=window))
    dirty = stored(Index(docs.select(F.col(text).alias("text")), phrases).exact().select("digest").distinct())
    return docs.join(dirty, digest_of(docs[text]) == dirty["digest"], "left_anti")


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark matches of every document; tested against a plain version."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
