"""The filter dialect: what differs from Spark SQL is rewritten, the rest is Spark's own parser and coercion.

Kept: double quotes are string literals, backticks quote names. Rewritten: integer `/` truncates when
both sides are integer columns or literals (`div`), `list[i]` on a list column counts from 1 (beyond its ends it is null),
and `[a, b]` where no name or bracket stands before it is an array.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .register import register, renamed

_CASTS = {
    "boolean": "boolean", "tinyint": "tinyint", "smallint": "smallint", "int": "int", "integer": "int", "bigint": "bigint", "float": "float", "double": "double",
    "string": "string", "binary": "binary", "date": "date", "timestamp": "timestamp_ntz", "decimal": "decimal",
}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DIVIDE = re.compile(r"(`[^`]+`|[A-Za-z_][\w.]*|\d+)\s*/\s*(`[^`]+`|[A-Za-z_][\w.]*|\d+)(?![\w.(])")


def _is_whole(token: str, df: DataFrame) -> bool:
    if token.isdigit():
        return True
    try:
        return isinstance(df.select(token).schema[0].dataType, _WHOLE)
    except Exception:  # noqa: BLE001 - no such column
        return False


_ITEM = re.compile(r"(`[^`]+`|[A-Za-z_][\w.]*)\[\s*(-?\d+)\s*\]")


def _is_list(token: str, df: DataFrame) -> bool:
    try:
        return isinstance(df.select(token).schema[0].dataType, T.ArrayType)
    except Exception:  # noqa: BLE001 - no such column
        return False


def _arrays(parts: list[str]) -> list[str]:
    """Turns the brackets of array literals into `array(...)`; parts at odd places are quoted strings."""
    open_: list[bool] = []
    before = ""
    out = []
    for i, part in enumerate(parts):
        if i % 2:
            out.append(part)
            before = "'"
            continue
        text = ""
        for c in part:
            if c == "[":
                open_.append(not (before.isalnum() or before in "_`)]'\""))
                text += "array(" if open_[-1] else c
            elif c == "]" and open_:
                text += ")" if open_.pop() else c
            else:
                text += c
            before = c if not c.isspace() else before
            if text.rstrip()[-3:].lower() == " in" and c.isspace():
                before = ""
        out.append(text)
    return out


def rewrite(text: str, df: DataFrame) -> str:
    """A filter or projection expression in Spark SQL."""
    parts = re.split(r"('(?:[^']|'')*'|\"[^\"]*\")", renamed(text))
    for i in range(0, len(parts), 2):
        parts[i] = _DIVIDE.sub(lambda m: f"({m[1]} div {m[2]})" if _is_whole(m[1], df) and _is_whole(m[2], df) else m[0], parts[i])
        parts[i] = _ITEM.sub(lambda m: f"get({m[1]}, {int(m[2]) - 1})" if _is_list(m[1], df) else m[0], parts[i])
    return "".join(_arrays(parts))


_OWN = re.compile(r"\b(?:json_\w+|array_has\w*|regexp_match|contains_tokens|\w+_distance|is_valid|strpos|to_hex)\s*\(", re.I)


def expression(text: str, df: DataFrame) -> Column:
    if _OWN.search(text):
        register(df.sparkSession)
    return F.expr(rewrite(text, df))


def predicate(text: str | Column, df: DataFrame) -> Column:
    """A filter that must be boolean; an array (as regexp_match may give) counts as true when it is there."""
    if not isinstance(text, str):
        return text
    column = expression(text, df)
    kind = df.select(column.alias("p")).schema[0].dataType
    if isinstance(kind, T.BooleanType):
        return column
    if isinstance(kind, T.ArrayType):
        return column.isNotNull()
    if isinstance(kind, _WHOLE):
        return column != 0
    raise ValueError(f"a filter must be boolean: {text!r} is {kind.simpleString()}")


def cast_type(name: str) -> str:
    """The Spark type of a type name that casts accept."""
    base, _, rest = name.lower().partition("(")
    if base not in _CASTS:
        raise ValueError(f"unsupported type {name!r}; one of {', '.join(_CASTS)}")
    if base == "decimal":
        return "decimal(" + (rest or "10,0)")
    if base == "timestamp" and rest and rest.rstrip(") ") not in ("0", "3", "6", "9"):
        raise ValueError("timestamp takes a precision of 0, 3, 6 or 9")
    return _CASTS[base]
