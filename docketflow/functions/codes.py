"""Structured codes inside JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketflow.functions import jsonvalue as J
from docketflow.functions import text as X


def _integer_text(value: Column) -> Column:
    """The digits of a JSON integer. Booleans and fractions are no integers."""
    return F.when(J.type_name(value) == "integer", J.get(value, "$", "string"))


# A leaf is read once as (schema, text): the schema of the value and the value as text. The
# schema of a scalar is one short word, so comparing it is cheap.


def leaf(value: Column) -> tuple[Column, Column]:
    """(schema, text) of a value."""
    return F.schema_of_variant(value), J.get(value, "$", "string")


def is_integer(schema: Column) -> Column:
    """Integers of up to 18 digits are BIGINT; a short DECIMAL(n,0) was written as 1.0."""
    return (schema == "BIGINT") | schema.rlike(r"^DECIMAL\((19|2[0-9]|3[0-9]),0\)$")


def cover_code(schema: Column, text: Column) -> Column:
    """An integer as text, or non-blank text; anything else is NULL."""
    return F.when(schema == "STRING", X.non_blank(text)).when(is_integer(schema), text)


def cover_text(schema: Column, text: Column) -> Column:
    """Non-blank text, trimmed; anything else is NULL."""
    return F.when(schema == "STRING", X.non_blank(text))


def rule_code(schema: Column, text: Column) -> Column:
    """A positive integer or ASCII digits, as text without leading zeros, else NULL."""
    digits = ((schema == "STRING") | is_integer(schema)) & text.rlike("^0*[1-9][0-9]*$")
    return F.when(digits, F.ltrim(text, F.lit("0")))


def _own_code(value: Column) -> Column:
    """The code of one object: an integer, or ASCII digits without leading zeros; else NULL."""
    code = J.get(value, "$.codigo")
    text = J.get(value, "$.codigo", "string")
    digits = F.when(J.is_text(code) & text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", ""))
    return F.coalesce(_integer_text(code), digits)


def nested_codes(value: Column) -> Column:
    """Codes of an object, of a list of objects, and of lists inside lists, as an array of text.

    Unlike a rule code, zero and negative integers count here. Each step opens one level of lists in
    place; a value has no more levels than opening brackets, so no list stays closed.
    """
    levels = F.coalesce(F.regexp_count(F.to_json(value), F.lit(r"\[")), F.lit(0))

    def open_lists(items: Column) -> Column:
        return F.flatten(F.transform(items, lambda item: F.coalesce(J.get(item, "$", "array<variant>"), F.array(item))))

    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    opened = F.aggregate(steps, F.array(value), lambda items, _: open_lists(items))
    return F.array_compact(F.transform(opened, lambda item: F.when(J.is_object(item), _own_code(item))))


def sorted_distinct(codes: Column) -> Column:
    return F.array_sort(F.array_distinct(codes))
