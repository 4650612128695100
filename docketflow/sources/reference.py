"""Small reference data: tribunals, signal rules, the theme catalog.

The tribunal list is fixed; rules and catalogs are checked on load. Joins with them are left to Spark's
own size checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.functions import jsonvalue as J
from docketflow.functions import text as X

# The 33 source aliases.
TRIBUNAL_ALIASES = (
    "tjac", "tjal", "tjam", "tjap", "tjba", "tjce", "tjdft", "tjes", "tjgo", "tjma", "tjmg",
    "tjms", "tjmt", "tjpa", "tjpb", "tjpe", "tjpi", "tjpr", "tjrj", "tjrn", "tjro", "tjrr",
    "tjrs", "tjsc", "tjse", "tjsp", "tjto", "trf1", "trf2", "trf3", "trf4", "trf5", "trf6",
)
TRIBUNALS = tuple(alias.upper() for alias in TRIBUNAL_ALIASES)


def tribunal_dimension(spark: SparkSession) -> DataFrame:
    """Alias, canonical name and kind of court."""
    rows = literal_frame(spark, [(alias,) for alias in TRIBUNAL_ALIASES], "alias string")
    return rows.select(
        "alias",
        F.upper("alias").alias("tribunal"),
        F.when(F.col("alias").startswith("trf"), "TRF")
        .when(F.col("alias") == "tjdft", "TJDFT")
        .otherwise("TJ")
        .alias("justice"),
    )


def canonical_tribunal(text: Column) -> Column:
    """The canonical name for an alias or name in any case, else NULL."""
    name = F.upper(X.strip(text))
    return F.when(name.isin(*TRIBUNALS), name)


def checked_tribunal(value: str) -> str:
    name = value.strip().upper()
    if name not in TRIBUNALS:
        raise ValueError(f"unknown tribunal: {value!r}")
    return name


@dataclass(frozen=True)
class SignalRule:
    """A rule that matches movement codes exactly."""

    rule_id: str
    version: str
    category: str
    name: str
    values: tuple[int, ...]
    enabled: tuple[str, ...]


# The built-in rules and the environments in which they are enabled.
BUILT_IN_RULES = (
    SignalRule("sinal.penhora", "1.0.0", "penhora", "Bloqueio, penhora ou arresto observado", (11382,), ("demo",)),
    SignalRule("sinal.leilao", "1.0.0", "leilao", "Leilão ou praça observado", (311,), ("demo", "real")),
    SignalRule(
        "sinal.recuperacao_judicial", "1.0.0", "recuperacao_judicial", "Recuperação judicial observada",
        (12041,), ("demo", "real"),
    ),
)

RULE_SCHEMA = (
    "rule_id string, rule_version string, category string, rule_name string, "
    "code_values array<bigint>, enabled_demo boolean, enabled_real boolean"
)

_RULE_DOCUMENT = (
    "schema_version INT, rules ARRAY<STRUCT<id: STRING, version: STRING, category: STRING, name: STRING, "
    "predicate: STRUCT<scope: STRING, field: STRING, operator: STRING, values: ARRAY<BIGINT>>, "
    "enablement: STRUCT<demo: STRUCT<enabled: BOOLEAN>, real: STRUCT<enabled: BOOLEAN>>>>"
)


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as literals of the plan, with a known size and without Python workers."""
    struct = T.StructType.fromDDL(schema)
    packed = F.array(*[
        F.struct(*[F.lit(value).cast(f.dataType).alias(f.name) for value, f in zip(row, struct.fields)])
        for row in rows
    ])
    return spark.range(1, numPartitions=1).select(F.inline(packed))


def rules_frame(spark: SparkSession, rules: tuple[SignalRule, ...] = BUILT_IN_RULES) -> DataFrame:
    """Rules given in code."""
    if not rules or len({(r.rule_id, r.version) for r in rules}) != len(rules):
        raise ValueError("a rule catalog needs rules with distinct ids and versions")
    for rule in rules:
        if not all(text.strip() for text in (rule.rule_id, rule.version, rule.category, rule.name)):
            raise ValueError("a rule has a blank text")
        if not rule.values or any(isinstance(v, bool) or not isinstance(v, int) or v <= 0 for v in rule.values):
            raise ValueError(f"rule {rule.rule_id!r} has an invalid code")
    rows = [
        (r.rule_id, r.version, r.category, r.name, list(r.values), "demo" in r.enabled, "real" in r.enabled)
        for r in rules
    ]
    return literal_frame(spark, rows, RULE_SCHEMA)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a JSON catalog file."""
    document = spark.read.schema(_RULE_DOCUMENT).json(path, multiLine=True, mode="FAILFAST")
    if document.where((F.col("schema_version") != 1) | F.col("schema_version").isNull()).count():
        raise ValueError("unsupported rule catalog version")
    rule = document.select(F.explode("rules").alias("r"))
    predicate = (F.col("r.predicate.scope") == "movement") & (F.col("r.predicate.field") == "codigo") & (
        F.col("r.predicate.operator") == "equals_any"
    )
    if rule.where(~F.coalesce(predicate, F.lit(False))).count():
        raise ValueError("a rule uses an unsupported predicate")
    return validated_rules(
        rule.select(
            F.col("r.id").alias("rule_id"), F.col("r.version").alias("rule_version"), "r.category",
            F.col("r.name").alias("rule_name"), F.col("r.predicate.values").alias("code_values"),
            F.col("r.enablement.demo.enabled").alias("enabled_demo"),
            F.col("r.enablement.real.enabled").alias("enabled_real"),
        )
    )


def validated_rules(rules: DataFrame) -> DataFrame:
    """Check names, codes and duplicates; the checks read the catalog only."""
    if rules.isEmpty():
        raise ValueError("a rule catalog needs at least one rule")
    texts = [F.col(name) for name in ("rule_id", "rule_version", "category", "rule_name")]
    blank = F.lit(False)
    for text in texts:
        blank = blank | text.isNull() | (F.trim(text) == "")
    codes = F.col("code_values")
    bad_codes = codes.isNull() | (F.size(codes) == 0) | F.exists(codes, lambda c: c.isNull() | (c <= 0))
    gates = F.col("enabled_demo").isNull() | F.col("enabled_real").isNull()
    if rules.where(blank | bad_codes | gates).count():
        raise ValueError("a rule has a blank text, an invalid code or no enablement")
    if rules.groupBy("rule_id", "rule_version").count().where("count > 1").count():
        raise ValueError("a rule id and version appears twice")
    return rules


def active_rules(rules: DataFrame, environment: str) -> DataFrame:
    """Rules enabled in an environment."""
    if environment not in ("demo", "real"):
        raise ValueError(f"unknown environment: {environment!r}")
    return rules.where(F.col(f"enabled_{environment}"))


def rule_selection(requested: DataFrame, rules: DataFrame, environment: str) -> DataFrame:
    """Requested rule ids with unknown, inactive or selected."""
    known = rules.select("rule_id", "rule_version", F.col(f"enabled_{environment}").alias("enabled"))
    return requested.select("rule_id").join(known, "rule_id", "left").select(
        "rule_id",
        "rule_version",
        F.when(F.col("enabled").isNull(), "unknown")
        .when(~F.col("enabled"), "inactive")
        .otherwise("selected")
        .alias("selection"),
    )


def select_rules(rules: DataFrame, environment: str, rule_ids: list[str] | None = None) -> DataFrame:
    """Enabled rules; asking for an unknown or a disabled one is an error."""
    spark = rules.sparkSession
    if rule_ids is None:
        rule_ids = [row.rule_id for row in rules.select("rule_id").distinct().collect()]
    if not rule_ids:
        raise ValueError("select at least one known rule")
    asked = literal_frame(spark, [(rule_id,) for rule_id in rule_ids], "rule_id string")
    refused = rule_selection(asked, rules, environment).where("selection <> 'selected'").collect()
    for row in refused:
        if row.selection == "unknown":
            raise LookupError(f"rule {row.rule_id!r} does not exist")
        raise PermissionError(f"rule {row.rule_id!r} is inactive in {environment}")
    return active_rules(rules, environment).where(F.col("rule_id").isin(*rule_ids))


@dataclass(frozen=True)
class ThemeCatalog:
    """Codes, items and their link table."""

    codes: DataFrame
    items: DataFrame
    item_codes: DataFrame
    families: DataFrame


_EVIDENCE = "STRUCT<state: STRING, reason: STRING>"
_CATALOG_DOCUMENT = (
    "schema_version INT, catalog_version STRING, tpu_version STRING, "
    "families ARRAY<STRUCT<id: STRING, name: STRING, investigation_state: STRING, item_ids: ARRAY<STRING>, "
    "pending_reason: STRING>>, "
    "tpu_code_evidence ARRAY<STRUCT<dimension: STRING, code: BIGINT, name: STRING, situation: STRING, "
    "tjgo_first_grade: BOOLEAN, tjgo_second_grade: BOOLEAN, selectable_for_custom: BOOLEAN>>, "
    "items ARRAY<STRUCT<kind: STRING, id: STRING, version: STRING, family: STRING, name: STRING, "
    "filters: STRUCT<classes: ARRAY<BIGINT>, subjects: ARRAY<BIGINT>, movements: ARRAY<BIGINT>>, "
    "combinations: STRUCT<between_dimensions: STRING>, capture_explanation: STRING, "
    f"tpu_status: {_EVIDENCE}, query_status: {_EVIDENCE}, sample_status: {_EVIDENCE}, "
    "required_for_real: ARRAY<STRING>, demo_available: BOOLEAN, runtime_implemented: BOOLEAN, exposure: STRING>>"
)


def read_theme_catalog(spark: SparkSession, path: str) -> ThemeCatalog:
    """A theme catalog file as tables; a broken catalog is refused."""
    document = spark.read.schema(_CATALOG_DOCUMENT).json(path, multiLine=True, mode="FAILFAST")
    if document.where(~F.coalesce(F.col("schema_version") == 1, F.lit(False))).count():
        raise ValueError("unsupported theme catalog version")
    codes = document.select(F.inline("tpu_code_evidence"))
    items = document.select("catalog_version", "tpu_version", F.inline("items"))
    families = document.select(F.inline("families"))
    def coded(dimension: str, field: str) -> Column:
        listed = F.coalesce(F.col(f"filters.{field}"), F.array().cast("array<bigint>"))
        return F.transform(listed, lambda code: F.struct(F.lit(dimension).alias("dimension"), code.alias("code")))

    links = items.select(
        F.col("id").alias("item_id"),
        F.explode(F.concat(coded("class", "classes"), coded("subject", "subjects"), coded("movement", "movements"))).alias("link"),
    ).select("item_id", "link.dimension", "link.code")
    catalog = ThemeCatalog(codes, items, links, families)
    # One row for each kind of problem: how many there are, and the first.
    problems = catalog_problems(catalog).groupBy("problem").agg(F.count("*").alias("n"), F.min("subject").alias("subject")).orderBy("problem").collect()
    if problems:
        raise ValueError("; ".join(f"{row.problem}: {row.subject}" + (f" and {row.n - 1} more" if row.n > 1 else "") for row in problems))
    return catalog


def catalog_problems(catalog: ThemeCatalog) -> DataFrame:
    """Broken references and duplicates of a catalog, one row each."""

    def found(rows: DataFrame, problem: str, subject: Column) -> DataFrame:
        return rows.select(F.lit(problem).alias("problem"), subject.cast("string").alias("subject"))

    key = F.concat_ws(":", F.col("dimension"), F.col("code").cast("string"))
    members = catalog.families.select("id", F.explode("item_ids").alias("item_id"))
    homes = catalog.items.select(F.col("id").alias("item_id"), F.col("family").alias("id"))
    usable = (F.col("situation") == "A") & (F.col("tjgo_first_grade") | F.col("tjgo_second_grade"))
    parts = [
        found(catalog.item_codes.join(catalog.codes, ["dimension", "code"], "left_anti"), "unknown code", key),
        found(catalog.codes.groupBy("dimension", "code").count().where("count > 1"), "duplicate code", key),
        found(catalog.items.groupBy("id").count().where("count > 1"), "duplicate item", F.col("id")),
        found(catalog.families.groupBy("id").count().where("count > 1"), "duplicate family", F.col("id")),
        found(members.join(homes, ["id", "item_id"], "left_anti"), "family without that item", F.col("item_id")),
        found(homes.join(members, "item_id", "left_anti"), "item without family", F.col("item_id")),
        found(
            catalog.families.where(
                (F.col("investigation_state") == "pending") & F.col("pending_reason").isNull()
            ),
            "pending family without reason", F.col("id"),
        ),
        found(catalog.codes.where(F.col("selectable_for_custom") & ~usable), "unusable code offered", key),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
