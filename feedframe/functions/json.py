"""Column helpers for JSON text and VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that JSON values counting as "nothing" take in a STRING field.
_EMPTY_TEXTS = ("", "{}", "[]", "0", "false")
# Line breaks that end a line of a JSON-lines body (a Java pattern).
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"
# Blanks removed around a line or a body.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\u0085\u00a0\u2028\u2029"


def truthy(text: Column) -> Column:
    """Whether a JSON value read as STRING is neither missing nor empty. Never null."""
    return text.isNotNull() & ~text.isin(*_EMPTY_TEXTS)


def when_truthy(text: Column) -> Column:
    """The value itself when it counts, else null."""
    return F.when(truthy(text), text)


def non_empty(text: Column) -> Column:
    """Text, with the empty string as null."""
    return F.nullif(text, F.lit(""))


def strip(text: Column) -> Column:
    # Trimming counts all characters of a text; one that begins and ends as an object has no blanks to lose.
    return F.when(text.startswith("{") & text.endswith("}"), text).otherwise(F.trim(text, F.lit(BLANKS)))


def to_long(text: Column) -> Column:
    """Whole number out of text, dropping a fraction; null when it is not a number."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def is_json(text: Column) -> Column:
    """Whether the text is exactly one JSON value.

    A bare parser stops after the first value and ignores what follows. Read as the only
    item of an array, trailing text is an error, unless it closes that array itself; then
    it does not close an object in whose place the text stands.
    """
    length = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    keys = F.json_object_keys(F.concat(F.lit('{"a":'), text, F.lit("}")))
    return F.coalesce((length == 1) & (F.size(keys) == 1), F.lit(False))


def child(value: Column, path: str) -> Column:
    """VARIANT at a path: SQL null when the key is absent, a null VARIANT when it is null."""
    return F.try_variant_get(value, path, "variant")


def text_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def items_at(value: Column, path: str, item: str = "variant") -> Column:
    """Array at a path, each item read as type ``item``; empty when there is none."""
    kind = f"array<{item}>"
    return F.coalesce(F.try_variant_get(value, path, kind), F.array().cast(kind))


def has_value(value: Column) -> Column:
    """Neither absent nor JSON null."""
    return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))


def counts(value: Column) -> Column:
    """Truth of a VARIANT, as a condition would see it: 0 is nothing, "0" is something."""
    return has_value(value) & ~F.to_json(value).isin("null", "false", "0", '""', "[]", "{}")


def is_object_at(value: Column, path: str) -> Column:
    """Whether a VARIANT has a JSON object at a path. Copies nothing of what that holds."""
    return F.try_variant_get(value, path, "struct<x:boolean>").isNotNull()


def is_object(value: Column) -> Column:
    """Whether a VARIANT is a JSON object."""
    return is_object_at(value, "$")


def keys_of(value: Column) -> Column:
    """Keys of a VARIANT object, null for any other value. Copies nothing of what they hold."""
    return F.map_keys(F.try_variant_get(value, "$", "map<string,boolean>"))


def bound(value: Column, use) -> Column:
    """``use`` of a value that it names more than once and that is worked out once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
