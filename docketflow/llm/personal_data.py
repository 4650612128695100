"""Personal data by candidate spans and boosted trees, in DataFrame functions only.

Base spans follow fixed patterns and checks. Beside them, high-recall generators propose
overlapping candidates of each kind. Gradient-boosted trees rate a candidate by its format and
the signs around it. There are no labelled spans, so the trees learn which candidates
meet a base span of their kind, without seeing what the base rule itself decides by (plus sign and country
code, checksum, the spelling of @ and dots). A candidate that meets none is unlabelled, not false: base misses true ones.
False for sure are those that fail the check of their kind or lie on a base span of another kind. A held-out
third of all candidates tells how often true candidates meet base, and sets each kind's threshold at a wanted
precision in proportion to that; a kind that does not reach it gets no added spans. The trees become one SQL
expression, so texts are scored where they lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm.registry import query, table
from docketflow.llm.rows import bound
from docketflow.operators.steps import computed_once
from docketflow.session import stored

KINDS = ("email", "ip", "card", "phone")
# Each finds what the plain pattern of its kind finds, without going back over long runs of its signs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:[.,:]\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])\+?\(?[0-9]{1,4}\)?(?:[\x20().-]{1,2}[0-9]{2,5}){1,4}(?![0-9])",
}
#: A text without these signs has no span of the kind, by either pattern.
NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
CONTEXT = 24
KEYWORDS = {"email": "mail|contact", "ip": "host|addr|server|ip", "card": "card|credit|visa|pay", "phone": "phone|tel|call|fax|mobil"}
#: Most candidates of each kind that the trees are fitted on, the lowest by hash; thresholds are set on all that are held out.
MAX_SAMPLE = 20_000
TREES, DEPTH = 8, 3
PRECISION = 0.97
#: Share of a form's candidates that must meet base before the form can be believed; below it nothing tells true ones from false.
MIN_MET = 0.5
#: Standard deviations by which a count may fall short of a share by chance.
NOISE = 2.0
#: Candidates that the shares of all kinds together count for beside a kind's own ones.
PRIOR = 20.0


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def is_valid(kind: str, match: Column) -> Column:
    digits = digits_of(match)
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def plain_form(kind: str, match: Column) -> Column:
    """The match without what base decides by: signs that stand for others, a phone's plus and its country or trunk code."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(match, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    if kind == "ip":
        return F.translate(match, ",:", "..")
    if kind == "card":
        return F.translate(match, " .", "--")
    return F.regexp_replace(match, r"^(?:\+[0-9]{1,3}(?=[\x20(.-])[\x20.-]?|\+|00[0-9]{1,3}[\x20.-]|1[\x20.-](?=[(0-9])|0(?=[1-9]))", "")


def found_spans(text: Column, kind: str, pattern: str, checked: bool) -> Column:
    """Matches in order as (k, s, e, m): the kind's number, code points from and to, and the match.

    The pieces between the matches tell where each one starts.
    """
    number = KINDS.index(kind)
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<k: INT, s: INT, e: INT, m: STRING>>)")

    def walk(matches: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        both = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["m"])
            span = F.struct(F.lit(number).alias("k"), start.alias("s"), end.alias("e"), x["m"].alias("m"))
            keep = is_valid(kind, x["m"]) if checked else F.lit(True)
            return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

        return F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("found")), step)["found"]

    def some(matches: Column) -> Column:
        return F.when(F.size(matches) > 0, walk(matches)).otherwise(empty)

    return F.when(text.rlike(NEEDS[kind]), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)).otherwise(empty)


def with_spans(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """doc_id, text, base spans and candidates of every row; a null text is empty.

    A candidate has its plain form as ``f``, and as ``ok`` whether it passes the check of its kind.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = F.concat(*[found_spans(F.col("text"), k, BASE[k], True) for k in KINDS])

    def candidates(kind: str) -> Column:
        def one(c: Column) -> Column:
            form = plain_form(kind, c["m"])
            checked = is_valid(kind, c["m"] if kind == "phone" else form)
            return F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"), form.alias("f"), checked.alias("ok"))

        return F.transform(found_spans(F.col("text"), kind, GENERATORS[kind], False), one)

    loose = F.concat(*[candidates(k) for k in KINDS])
    return computed_once(source.select("doc_id", "text", base.alias("base"), loose.alias("loose")))


def features(text: Column, span: Column) -> dict[str, Column]:
    """Format of the candidate's plain form and signs around it."""
    match, left = span["f"], F.lower(F.substring(text, F.greatest(span["s"] - CONTEXT, F.lit(0)) + 1, F.least(span["s"], F.lit(CONTEXT))))
    before, after = F.substring(left, -1, 1), F.substring(text, span["e"] + 1, 1)

    def number(value: Column) -> Column:
        return value.cast("double")

    out = {
        "kind": number(span["k"]), "length": number(F.length(match)), "digits": number(F.length(digits_of(match))),
        "letters": number(F.length(F.regexp_replace(match, "[^A-Za-z]", ""))), "groups": number(F.size(F.split(match, "[^0-9A-Za-z]+"))),
        "dots": number(F.length(match) - F.length(F.replace(match, F.lit("."), F.lit("")))),
        "spaces": number(F.length(match) - F.length(F.replace(match, F.lit(" "), F.lit("")))),
        "parens": number(match.contains("(")), "at": number(match.contains("@")),
        "first": number(F.coalesce(F.ascii(F.regexp_extract(match, "[0-9]", 0)), F.lit(0))),
        "before_letter": number(before.rlike(r"[\p{L}_]")), "before_sign": number(before.rlike(r"[^\s\p{L}0-9]")),
        "after_letter": number(after.rlike(r"[\p{L}_]")), "after_sign": number(after.rlike(r"[^\s\p{L}0-9.,;:)]")),
    }
    return out | {f"near_{k}": number(left.rlike(words)) for k, words in KEYWORDS.items()}


FEATURES = tuple(["kind", "length", "digits", "letters", "groups", "dots", "spaces", "parens", "at", "first", "before_letter", "before_sign",
                  "after_letter", "after_sign", *[f"near_{k}" for k in KINDS]])


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def rated_candidates(spans: DataFrame) -> DataFrame:
    """All different candidates with features and weak label; ``held`` marks a third of them by hash.

    The label is 1 where the candidate meets a base span of its kind, 0 where it is false for sure, and null
    where nothing is known.
    """
    picked = spans.where(F.size("loose") > 0).select("text", "base", F.explode("loose").alias("c"))
    rank = F.xxhash64(F.col("c.m"), F.col("text"), F.col("c.s"))
    met = F.exists("base", lambda b: (b["k"] == F.col("c.k")) & overlaps(b, F.col("c")))
    false = ~F.col("c.ok") | F.exists("base", lambda b: overlaps(b, F.col("c")))
    label = F.when(met, 1.0).when(false, 0.0)
    rows = picked.select(rank.alias("rank"), label.alias("label"), *[c.alias(n) for n, c in features(F.col("text"), F.col("c")).items()])
    return rows.distinct().withColumn("held", F.pmod("rank", F.lit(3)) == 0)


def sample_of(candidates: DataFrame, most: int = MAX_SAMPLE) -> DataFrame:
    """Of each kind at most ``most`` candidates that are not held out, the lowest by hash, so that no kind crowds out another."""
    free = candidates.where("NOT held")
    parts = [free.where(F.col("kind") == k).orderBy("rank", *FEATURES, "label").limit(most) for k in range(len(KINDS))]
    return reduce(DataFrame.unionByName, parts)


def _tree(node, values: Column) -> Column:
    """A fitted tree as nested CASE expressions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    test = values[FEATURES[split.featureIndex()]] <= F.lit(float(split.threshold()))
    return F.when(test, _tree(node.leftChild(), values)).otherwise(_tree(node.rightChild(), values))


class Trees:
    """The fitted trees as an expression over a struct of features."""

    def __init__(self, model):
        self.weights = list(model.treeWeights)
        self.roots = [t._call_java("rootNode") for t in model.trees]

    def margin(self, values: Column) -> Column:
        return sum((_tree(r, values) * w for r, w in zip(self.roots, self.weights)), F.lit(0.0))


def enough(good: float, total: int, share: float, precision: float = 1.0) -> bool:
    """Whether ``good`` of ``total`` reach the share by the precision, but for chance; a share of 1 leaves nothing to chance."""
    return good >= precision * share * total - NOISE * (total * share * (1 - share)) ** 0.5


def cuts_of(rated, precision: float) -> dict[int, float]:
    """The margin each kind's candidates need, of rows (k, v, good, open, n): met, unlabelled and all candidates of a margin.

    True candidates meet base in a share that is taken from the margins where those lie that do meet it. So
    many of the candidates from a threshold on must have met base, times the precision. A kind's counts are joined by
    ``PRIOR`` candidates of all kinds with the same margins, so that few candidates are judged by what the trees are worth elsewhere, and
    many by themselves. No number of candidates switches a kind on or off.
    """
    rows = sorted(rated, key=lambda r: (r["k"], -r["v"]))
    margins = sorted({r["v"] for r in rows}, reverse=True)
    kinds = {k: {r["v"]: (r["good"], r["open"], r["n"]) for r in rows if r["k"] == k} for k in range(len(KINDS))}
    whole = {v: tuple(sum(held[v][i] for held in kinds.values() if v in held) for i in range(3)) for v in margins}

    def met_of(held: dict) -> tuple[float, float]:
        """How many met base, and of how many of them the others of their margin did: one alone says nothing."""
        many = [(good, good + free) for good, free, _ in held.values() if good + free > 1]
        return sum(g for g, _ in many), sum(g * (g - 1) / (n - 1) for g, n in many)

    all_met, all_others = met_of(whole)
    if not all_met:
        return {}
    cuts: dict[int, float] = {}
    for kind, held in kinds.items():
        met, others = met_of(held)
        share = max(MIN_MET, (others + PRIOR * all_others / all_met) / (met + PRIOR))
        good = total = all_good = all_total = 0.0
        for v in margins:
            own, every = held.get(v, (0, 0, 0)), whole[v]
            good, total, all_good, all_total = good + own[0], total + own[2], all_good + every[0], all_total + every[2]
            from_here = enough(good + PRIOR * all_good / all_total, total + PRIOR, share, precision)
            if from_here and enough(own[0] + PRIOR * every[0] / every[2], own[2] + PRIOR, MIN_MET):
                cuts[kind] = v
    return cuts


def fit(spans: DataFrame, precision: float = PRECISION) -> tuple[Trees | None, dict[int, float]]:
    """Trees and the margin each kind's candidates need; no trees where the sample has one class only."""
    candidates = stored(rated_candidates(spans))
    fitted = stored(sample_of(candidates).withColumn("label", F.coalesce("label", F.lit(0.0))))
    if fitted.select("label").distinct().count() < 2:
        return None, {}
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(fitted).select("features", "label")
    trees = Trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(ready))
    margin = trees.margin(F.struct(*FEATURES))
    # As many rows as the trees have distinct sums, however many candidates there are.
    rated = candidates.where("held").select(F.col("kind").cast("int").alias("k"), margin.alias("v"), "label").groupBy("k", "v").agg(
        F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label").isNull()).alias("open"), F.count("*").alias("n"))
    return trees, cuts_of(rated.collect(), precision)


def personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """Every row with its base spans and all spans that go.

    Null and empty texts have none. Repeated rows get equal results. A candidate that meets a base
    span adds nothing, so a base span is never moved, and one that fails the check of its kind is not added. Without examples of both classes, or where no threshold
    reaches the precision, only base spans are given.
    """
    spans = with_spans(docs, id_column, text)
    trees, cuts = fit(spans, precision)
    added = F.expr("CAST(array() AS ARRAY<STRUCT<k: INT, s: INT, e: INT>>)")
    if trees is not None and cuts:
        def chosen(span: Column) -> Column:
            free = ~F.exists("base", lambda b: overlaps(b, span))
            cut = F.lit(None).cast("double")
            for kind, value in cuts.items():
                cut = F.when(span["k"] == kind, F.lit(value)).otherwise(cut)
            values = F.struct(*[c.alias(n) for n, c in features(F.col("text"), span).items()])
            return free & span["ok"] & F.coalesce(bound(values, trees.margin) >= cut, F.lit(False))

        kept = F.filter("loose", chosen)
        added = F.when(F.size("loose") > 0, F.transform(kept, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))).otherwise(added)
    base = F.transform("base", lambda b: F.struct(b["k"].alias("k"), b["s"].alias("s"), b["e"].alias("e")))
    rows = computed_once(spans.select("doc_id", "text", base.alias("base"), F.array_sort(F.concat(base, added)).alias("spans")))
    names = F.array(*[F.lit(k) for k in KINDS])

    def spelled(column: str) -> Column:
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", "text", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"), F.col("spans").alias("places"))


def redacted(docs: DataFrame, id_column: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; spans that overlap are replaced as one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        inside = x["s"] < acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        new = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.element_at(names, x["k"] + 1)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), new.alias("out"))

    ordered = F.array_sort(F.transform("places", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    folded = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    whole = bound(folded, lambda f: F.concat(f["out"], F.substring(F.col("text"), f["at"] + 1, F.length("text"))))
    return personal_data(docs, id_column, text, precision).select("doc_id", whole.alias("text"))


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents; base spans are tested against plain patterns."""
    return personal_data(table(spark, sf_dir, "documents")).drop("text", "places")
