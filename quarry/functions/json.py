"""Columns on JSON: the first value in free text, checks against a small schema, lists keyed by a field."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_DECODER = json.JSONDecoder()


def _first(text: str | None) -> str | None:
    for at, char in enumerate(text or ""):
        if char in "{[":
            try:
                return text[at : _DECODER.raw_decode(text, at)[1]]
            except (ValueError, RecursionError):
                pass
    return None


@pandas_udf(StringType())
def _first_values(texts: pd.Series) -> pd.Series:
    return texts.map(_first)


def first_json(text: Column) -> Column:
    """The first object or list in the text, marks of a code block aside, as it is written; NULL for none.

    Where a value ends is known to a JSON parser alone, so this is one Arrow batch call; what follows stays in the JVM.
    """
    bare = F.regexp_replace(F.trim(text), "^```[a-zA-Z0-9]*\n|\n```\\s*$", "")
    return F.when(bare.rlike(r"[{\[]"), _first_values(bare))


_KINDS = {
    "object": ("OBJECT", "a JSON object"), "array": ("ARRAY", "a JSON array"), "string": ("STRING", "a string"), "boolean": ("BOOLEAN", "a boolean"),
    "number": ("BIGINT|DOUBLE|FLOAT|DECIMAL", "a number"), "integer": ("BIGINT", "an integer"),
}


def schema_error(value: Column, schema: dict, where: str | Column = "output") -> Column:
    """What is wrong with a variant by a schema (type, required, properties, items, maxItems, enum): the first fault, or NULL.

    The schema is walked when the plan is made; each check is one expression.
    """
    at = F.lit(where) if isinstance(where, str) else where
    kind = schema.get("type", "object")
    prefix, named = _KINDS[kind]
    right = F.coalesce(F.schema_of_variant(value).rlike(f"^({prefix})"), F.lit(False))
    if kind == "integer":  # another number is told apart from what is none
        number = F.coalesce(F.schema_of_variant(value).rlike(f"^({_KINDS['number'][0]})"), F.lit(False))
        faults = [F.when(~number, F.concat(at, F.lit(" must be a number"))), F.when(~right, F.concat(at, F.lit(" must be an integer")))]
    else:
        faults = [F.when(~right, F.concat(at, F.lit(f" must be {named}")))]
    part = lambda key, of="variant": F.try_variant_get(value, f"$['{key}']", of)
    if kind == "object":
        faults += [F.when(part(k).isNull(), F.concat(at, F.lit(f" missing required key '{k}'"))) for k in schema.get("required", [])]
        faults += [F.when(part(k).isNotNull(), schema_error(part(k), s, F.concat(at, F.lit(f".{k}")))) for k, s in schema.get("properties", {}).items()]
    elif kind == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        if "items" in schema:
            each = F.transform(items, lambda x, k: schema_error(x, schema["items"], F.concat(at, F.lit("["), k.cast("string"), F.lit("]"))))
            faults.append(F.get(F.filter(each, lambda e: e.isNotNull()), F.lit(0)))
        if "maxItems" in schema:
            faults.append(F.when(F.size(items) > schema["maxItems"], F.concat(at, F.lit(f" exceeds {schema['maxItems']} items"))))
    elif "enum" in schema:
        faults.append(F.when(~F.coalesce(F.try_variant_get(value, "$", "string").isin([str(e) for e in schema["enum"]]), F.lit(False)), F.concat(at, F.lit(f" must be one of {sorted(schema['enum'])}"))))
    return F.coalesce(*faults)


def keyed(items: Column, key: str) -> Column:
    """A map from a field of the list's structs to the struct; of equal keys the last struct stays, at the first one's place."""
    names = F.array_distinct(F.transform(F.filter(items, lambda x: x[key].isNotNull()), lambda x: x[key]))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(items, lambda x: x[key] == k), -1).alias("value"))))
