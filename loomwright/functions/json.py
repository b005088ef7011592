"""JSON functions over strings; paths as `$.a.b[0]`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _variant(doc: Column) -> Column:
    return F.try_parse_json(doc)


def child(key: str | int) -> str:
    """The path of a key or, for a number, of an index."""
    return f"$[{key}]" if isinstance(key, int) or str(key).isdigit() else f"$.{key}"


def json_extract(doc: Column, path: str) -> Column:
    """The match as JSON text: strings keep their quotes."""
    return F.to_json(F.try_variant_get(_variant(doc), path, "variant"))


def json_exists(doc: Column, path: str) -> Column:
    """Whether the path matches, JSON null included."""
    return F.when(doc.isNotNull(), F.try_variant_get(_variant(doc), path, "variant").isNotNull())


def json_get(doc: Column, key: str | int) -> Column:
    return json_extract(doc, child(key))


def json_get_string(doc: Column, key: str | int) -> Column:
    return F.try_variant_get(_variant(doc), child(key), "string")


def json_get_int(doc: Column, key: str | int) -> Column:
    return F.try_variant_get(_variant(doc), child(key), "bigint")


def json_get_float(doc: Column, key: str | int) -> Column:
    return F.try_variant_get(_variant(doc), child(key), "double")


def json_get_bool(doc: Column, key: str | int) -> Column:
    return F.try_variant_get(_variant(doc), child(key), "boolean")


def json_array_contains(doc: Column, path: str, value: str) -> Column:
    """Whether an element equals the value, as a string or as JSON text."""
    items = F.try_variant_get(_variant(doc), path, "array<variant>")
    return F.exists(items, lambda x: F.to_json(x).isin(value, f"\"{value}\""))


def json_array_length(doc: Column, path: str) -> Column:
    """The number of elements; null for a missing path, an error for anything but an array."""
    found = F.try_variant_get(_variant(doc), path, "variant")
    items = F.try_variant_get(_variant(doc), path, "array<variant>")
    wrong = F.raise_error(F.lit(f"json_array_length: {path} is not an array")).cast("int")
    return F.when(found.isNull(), F.lit(None).cast("int")).when(items.isNotNull(), F.size(items)).otherwise(wrong).cast("long")


_TAGS = {"VOID": 0, "BOOLEAN": 1, "BIGINT": 2, "DOUBLE": 3, "STRING": 4}


def json_extract_with_type(doc: Column, path: str) -> Column:
    """struct(value as JSON text, type_tag): 0 null, 1 bool, 2 integer, 3 float, 4 string, 5 array, 6 object."""
    found = F.try_variant_get(_variant(doc), path, "variant")
    kind = F.schema_of_variant(found)
    tag = F.when(kind.startswith("ARRAY"), 5).when(kind.startswith("OBJECT"), 6).when(kind.startswith("DECIMAL"), 3)
    for name, number in _TAGS.items():
        tag = tag.when(kind == name, number)
    return F.when(found.isNotNull(), F.struct(F.to_json(found).alias("value"), tag.alias("type_tag")))
