"""JSON held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHADES = "array<struct<shade:string,reference:string,arabic_word:string,explanation:string>>"
QUOTES = "array<struct<arabic:string,translation:string>>"


def array_or_empty(text: Column, schema: str) -> Column:
    """The array, or an empty one where the text is null, empty or isn't an array."""
    return F.when(text.rlike(r"^\s*\["), F.coalesce(F.from_json(text, schema), F.array().cast(schema))).otherwise(F.array().cast(schema))


def list_size(text: Column, schema: str) -> Column:
    """Length of the array, 0 where there is none."""
    return F.size(array_or_empty(text, schema))


def kind(text: Column) -> Column:
    """``empty``, ``invalid``, ``OBJECT``, ``ARRAY``, ``STRING`` and so on."""
    value = F.try_parse_json(text)
    name = F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(value.isNull(), "invalid").otherwise(name)


def kind_of_key(text: Column, key: str) -> Column:
    value = F.try_variant_get(F.try_parse_json(text), f"$.{key}", "variant")
    return F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)


def dumps(value: Column) -> Column:
    return F.to_json(value)


def map_rows(json_text: Column) -> Column:
    """Map of text to arrays of text."""
    return F.from_json(json_text, "map<string,array<string>>")
