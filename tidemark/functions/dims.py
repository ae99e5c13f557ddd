"""Dimensions: JSON objects with sorted keys, kept as text so that they can be keys of groups and joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "{}"


def canonical(dims: Column, lenient: bool = True) -> Column:
    """``dims`` as a JSON object with sorted keys. What is not an object becomes ``{}``, or raises unless ``lenient``."""
    text = F.coalesce(F.nullif(F.trim(dims), F.lit("")), F.lit(EMPTY))
    good = is_object(text)
    out = F.to_json(F.try_parse_json(text))
    return F.when(good, out).otherwise(F.lit(EMPTY) if lenient else F.raise_error(F.concat(F.lit("dims is not a JSON object: "), text)).cast("string"))


def is_object(dims: Column) -> Column:
    """Whether the text is a JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(dims)).startswith("OBJECT"), F.lit(False))


def get(dims: Column, key: str) -> Column:
    return F.get_json_object(dims, f"$.{key}")


def build(**values: Column) -> Column:
    """A JSON object of the non-null values, keys sorted."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))


def matches(dims: Column, key: str | None, value: str | None) -> Column:
    """Whether ``dims`` has ``value`` under ``key``, or no ``key`` where value is None; without a key everything matches."""
    if key is None:
        return F.lit(True)
    return get(dims, key).isNull() if value is None else get(dims, key) == value


def pairs(dims: Column) -> Column:
    """Array of ``key=value`` texts."""
    entries = F.map_entries(F.from_json(dims, "map<string,string>"))
    return F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"]))
