"""JSON values: typed access, type names, canonical text and content hashes.

Canonical text has object keys in code-point order, no insignificant blanks, and keeps array
order, nulls, and the difference between 1, 1.0, "1" and true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.functions.exact import CURSOR_KEY, HIDDEN_NUMBER, canonical_texts, redacted_texts

# A VARIANT normalises 1.0 to 1 and sorts keys by UTF-16 unit, and it writes control characters
# with upper-case escapes. A text that may hold any of these takes the exact path below. The tests
# may hit too often (a number inside a string), never too seldom. A number follows a key and its
# colon, a bracket or a comma; the clock digits of a date text follow another digit and a colon.
_ODD_NUMBER = r'(?:^|"\s*+:|[\[,])\s*+-?+(?:[0-9]{38}|[0-9]++[.eE])'
_ODD_ESCAPE = r"\\u(?:00|[dD][89abAB])"
_ODD_CHARACTER = r"[\x{10000}-\x{10FFFF}]"


def get(value: Column, path: str, as_type: str = "variant") -> Column:
    """The value at a path, or NULL when it is missing or has no such type."""
    return F.try_variant_get(value, path, as_type)


def is_json_null(value: Column) -> Column:
    """True for an explicit JSON null, false for a missing value."""
    return F.coalesce(F.is_variant_null(value), F.lit(False))


_KINDS = {
    "VOID": "null", "BOOLEAN": "boolean", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number",
    "FLOAT": "number", "STRING": "string", "OBJECT": "object", "ARRAY": "array",
}


def type_name(value: Column) -> Column:
    """null, boolean, integer, number, string, object or array; NULL when missing."""
    schema = F.schema_of_variant(value)
    # Integers of up to 18 digits are BIGINT, so a short DECIMAL(n,0) was written as 1.0.
    plain = F.regexp_replace(schema, r"^DECIMAL\((19|2[0-9]|3[0-9]),0\)$", "BIGINT")
    word = F.regexp_replace(plain, r"(?s)[<(].*", "")
    kinds = F.create_map(*[F.lit(part) for pair in _KINDS.items() for part in pair])
    return F.element_at(kinds, word)


def is_object(value: Column) -> Column:
    return get(value, "$", "map<string,variant>").isNotNull()


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def text_at(value: Column, path: str) -> Column:
    """The text at a path, and NULL when the value there is not a JSON string."""
    part = get(value, path)
    return F.when(is_text(part), get(value, path, "string"))


def needs_exact(text: Column) -> Column:
    """Whether native VARIANT text could differ from the canonical text."""
    escapes = F.contains(text, F.lit("\\u")) & text.rlike(_ODD_ESCAPE)
    characters = (F.octet_length(text) != F.char_length(text)) & text.rlike(_ODD_CHARACTER)
    # The first, cheap test settles nearly every text.
    numbers = (text.rlike(r"[.eE](?<=[0-9].)") | text.rlike(r"[0-9]{38}")) & text.rlike(_ODD_NUMBER)
    return F.coalesce(numbers | escapes | characters, F.lit(False))


_canonical_exact = F.pandas_udf(canonical_texts, T.StringType())


def rewrite(native: Column, text: Column) -> Column:
    """The native canonical text where there is one, else the text in its exact form.

    Rows with a native form send the Arrow helper a NULL.
    """
    return F.coalesce(native, _canonical_exact(F.when(native.isNull(), text)))


def canonical_json(text: Column) -> Column:
    """Canonical text of a JSON text, NULL for text that is no JSON value.

    Nearly every row is rewritten inside the JVM; only rows with fractions, very long numbers or
    unusual characters take the exact form.
    """
    return rewrite(F.when(~needs_exact(text), F.to_json(F.try_parse_json(text))), text)


def content_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def quoted(text: Column) -> Column:
    """A text as a JSON string literal."""
    return F.to_json(text.cast("variant"))


def json_object(*fields: tuple[str, Column]) -> Column:
    """An object text from (key, JSON text) pairs given in key order; NULL texts are left out."""
    parts = [F.concat(F.lit(f'"{key}":'), text) for key, text in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


_redacted_exact = F.pandas_udf(redacted_texts, T.StringType())


def redact(text: Column) -> Column:
    """Hide every 20-digit text value and the values of every cursor list in a JSON text.

    Works at any depth and leaves object keys and all other values as they are. A text that names a cursor takes the
    exact form; in the others a whole string value is replaced where it stands.
    """
    has_cursor = F.contains(text, F.lit(CURSOR_KEY)) | F.contains(text, F.lit("\\"))
    replaced = F.regexp_replace(text, r'(?<=[\[,:])(\s*)"[0-9]{20}"(?=\s*[,\]}])', f'$1"{HIDDEN_NUMBER}"')
    return F.coalesce(canonical_json(F.when(~has_cursor, replaced)), _redacted_exact(F.when(has_cursor, text)))
