"""Registers the engine's functions under their SQL names for a session."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: SQL bodies; the session inlines them, so they stay inside generated code.
_SQL = {
    "contains_tokens(t STRING, q STRING) RETURNS BOOLEAN": r"size(array_except(filter(split(q, '[^\\p{L}\\p{N}]+'), x -> x <> ''), filter(split(t, '[^\\p{L}\\p{N}]+'), x -> x <> ''))) = 0",
    "json_extract(j STRING, p STRING) RETURNS STRING": "to_json(try_variant_get(try_parse_json(j), p, 'variant'))",
    "json_exists(j STRING, p STRING) RETURNS BOOLEAN": "if(j IS NULL, NULL, try_variant_get(try_parse_json(j), p, 'variant') IS NOT NULL)",
    "json_get(j STRING, k STRING) RETURNS STRING": "to_json(try_variant_get(try_parse_json(j), if(k RLIKE '^[0-9]+$', concat('$[', k, ']'), concat('$.', k)), 'variant'))",
    "json_get_string(j STRING, k STRING) RETURNS STRING": "try_variant_get(try_parse_json(j), if(k RLIKE '^[0-9]+$', concat('$[', k, ']'), concat('$.', k)), 'string')",
    "json_get_int(j STRING, k STRING) RETURNS BIGINT": "try_variant_get(try_parse_json(j), if(k RLIKE '^[0-9]+$', concat('$[', k, ']'), concat('$.', k)), 'bigint')",
    "json_get_float(j STRING, k STRING) RETURNS DOUBLE": "try_variant_get(try_parse_json(j), if(k RLIKE '^[0-9]+$', concat('$[', k, ']'), concat('$.', k)), 'double')",
    "json_get_bool(j STRING, k STRING) RETURNS BOOLEAN": "try_variant_get(try_parse_json(j), if(k RLIKE '^[0-9]+$', concat('$[', k, ']'), concat('$.', k)), 'boolean')",
    "json_array_contains(j STRING, p STRING, v STRING) RETURNS BOOLEAN": "exists(try_variant_get(try_parse_json(j), p, 'array<variant>'), x -> to_json(x) = v OR to_json(x) = concat('\"', v, '\"'))",
    "l2_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)",
    "dot_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))",
    "json_length_at(j STRING, p STRING) RETURNS BIGINT": "CASE WHEN try_variant_get(try_parse_json(j), p, 'variant') IS NULL THEN NULL WHEN try_variant_get(try_parse_json(j), p, 'array<variant>') IS NOT NULL THEN size(try_variant_get(try_parse_json(j), p, 'array<variant>')) ELSE CAST(raise_error(concat('json_array_length: ', p, ' is not an array')) AS INT) END",
    "json_type_tag(k STRING) RETURNS INT": "CASE WHEN k LIKE 'ARRAY%' THEN 5 WHEN k LIKE 'OBJECT%' THEN 6 WHEN k LIKE 'DECIMAL%' THEN 3 WHEN k = 'VOID' THEN 0 WHEN k = 'BOOLEAN' THEN 1 WHEN k = 'BIGINT' THEN 2 WHEN k = 'DOUBLE' THEN 3 WHEN k = 'STRING' THEN 4 END",
    "json_extract_with_type(j STRING, p STRING) RETURNS STRUCT<value: STRING, type_tag: INT>": "if(try_variant_get(try_parse_json(j), p, 'variant') IS NULL, NULL, named_struct('value', to_json(try_variant_get(try_parse_json(j), p, 'variant')), 'type_tag', json_type_tag(schema_of_variant(try_variant_get(try_parse_json(j), p, 'variant')))))",
    "hamming_distance(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0D, (s, x) -> s + x)",
    "array_has(a ARRAY<STRING>, v STRING) RETURNS BOOLEAN": "array_contains(a, v)",
    "array_has_any(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS BOOLEAN": "arrays_overlap(a, b)",
    "array_has_all(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS BOOLEAN": "size(array_except(b, a)) = 0",
    "regexp_match(s STRING, p STRING) RETURNS BOOLEAN": "s RLIKE p",
    "is_valid(s STRING) RETURNS BOOLEAN": "s IS NOT NULL",
    "strpos(s STRING, p STRING) RETURNS INT": "instr(s, p)",
    "to_hex(n BIGINT) RETURNS STRING": "lower(hex(n))",
}


def renamed(sql: str) -> str:
    """The engine's two-argument json_array_length has another name in the session, where that of one argument is built in."""
    return re.sub(r"\bjson_array_length(\s*\((?:[^(),']|'[^']*'|\((?:[^()']|'[^']*')*\))*,)", r"json_length_at\1", sql, flags=re.I)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions temporary functions of the session; gives their names."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in _SQL]
