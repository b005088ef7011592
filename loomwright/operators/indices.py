"""Secondary indices as sidecar tables under a table's folder, and their lifecycle.

Spark reads less when the sidecar answers a predicate than when the table does: a BTREE sidecar is sorted by value (Parquet
statistics prune it), BITMAP holds rows by value, LABEL_LIST rows by label, NGRAM rows by trigram, ZONEMAP ranges of values per 8192
rows, BLOOMFILTER Parquet's own filters, INVERTED postings, IVF_* partitions with codes. Lookups give row ids; the original
predicate is always checked again on the rows, and rows of fragments that an index doesn't cover are added to its answer.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import predicate
from ..functions.json import json_get_string
from ..functions.text import lowered, slabs, trigrams
from ..sources.table import POINTS, ROWID, Table, TableError, origins
from . import fts, vector

ZONE = 8192


class ScalarIndex(Protocol):
    """What an index type provides: its sidecar, and the candidates of a lookup (None: can't answer): row ids, or `zone` numbers."""

    def build(self, rows: DataFrame, column: str) -> DataFrame: ...

    def lookup(self, sidecar: DataFrame, op: str, value) -> DataFrame | None: ...


class BTree:
    def build(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.select(F.col(column).alias("value"), ROWID).repartitionByRange("value").sortWithinPartitions("value")

    def lookup(self, sidecar: DataFrame, op: str, value) -> DataFrame | None:
        v = F.col("value")
        test = {"=": lambda: v == value, "in": lambda: v.isin(*value), "<": lambda: v < value, "<=": lambda: v <= value, ">": lambda: v > value, ">=": lambda: v >= value, "between": lambda: v.between(*value), "is null": v.isNull, "is not null": v.isNotNull}.get(op)
        return sidecar.filter(test()).select(ROWID) if test else None


class Bitmap(BTree):
    def build(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.select(F.col(column).alias("value"), ROWID).repartition("value").sortWithinPartitions("value", ROWID)


class BloomFilter(BTree):
    def lookup(self, sidecar: DataFrame, op: str, value) -> DataFrame | None:
        return super().lookup(sidecar, op, value) if op in ("=", "in", "is null") else None


class LabelList:
    def build(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.select(ROWID, F.explode(column).alias("label")).distinct().repartitionByRange("label").sortWithinPartitions("label")

    def lookup(self, sidecar: DataFrame, op: str, value) -> DataFrame | None:
        labels = list(dict.fromkeys(value if isinstance(value, (list, tuple)) else [value]))
        near = sidecar.filter(F.col("label").isin(*labels))
        if op == "has any":
            return near.select(ROWID).distinct()
        if op == "has all":
            return near.groupBy(ROWID).agg(F.countDistinct("label").alias("n")).filter(F.col("n") == len(labels)).select(ROWID)
        return None


class NGram:
    """Trigrams of the lower-cased text, each with the ids of a few megabytes of text in a row; a shorter needle can't be answered."""

    def build(self, rows: DataFrame, column: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, part in slabs(batch.column(1)):
                    grams, edges, of = trigrams(part)
                    ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), batch.column(0).take(pa.array(of + row)))
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), ids], ["gram", "ids"])

        packed = rows.filter(F.col(column).isNotNull()).select(ROWID, column).mapInArrow(run, "gram string, ids array<long>")
        return packed.repartition("gram").sortWithinPartitions("gram")

    def lookup(self, sidecar: DataFrame, op: str, value) -> DataFrame | None:
        if op != "contains":
            return None
        low = lowered(pa.array([value]))[0].as_py()
        if len(low) < 3:
            return None
        grams = {low[i : i + 3] for i in range(len(low) - 2)}
        near = sidecar.filter(F.col("gram").isin(*grams)).select("gram", F.explode("ids").alias(ROWID))
        return near.groupBy(ROWID).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select(ROWID)


class ZoneMap:
    """min, max, nulls and NaNs of every zone of row ids; its candidates are zones, given as ranges of ids."""

    def build(self, rows: DataFrame, column: str) -> DataFrame:
        c = F.col(column)
        kind = rows.schema[column].dataType.simpleString()
        nan = F.isnan(c) if kind in ("float", "double") else F.lit(False)
        sound = F.when(~nan, c)
        zone = F.floor(F.col(ROWID) / ZONE)
        return rows.groupBy(zone.alias("zone")).agg(F.min(sound).alias("low"), F.max(sound).alias("high"), F.sum(c.isNull().cast("long")).alias("nulls"), F.sum(F.coalesce(nan, F.lit(False)).cast("long")).alias("nans"), F.count(F.lit(1)).alias("rows"))

    def zones(self, sidecar: DataFrame, op: str, value) -> DataFrame | None:
        low, high, nan = F.col("low"), F.col("high"), F.col("nans") > 0  # a NaN is greater than any number
        test = {"=": lambda: (low <= value) & (high >= value), "<": lambda: low < value, "<=": lambda: low <= value, ">": lambda: (high > value) | nan, ">=": lambda: (high >= value) | nan, "between": lambda: (low <= value[1]) & (high >= value[0]), "in": lambda: F.exists(F.array(*(F.lit(v) for v in value)), lambda v: (low <= v) & (high >= v)), "is null": lambda: F.col("nulls") > 0}.get(op)
        return sidecar.filter(test()).select("zone") if test else None

    def lookup(self, sidecar: DataFrame, op: str, value) -> DataFrame | None:
        return self.zones(sidecar, op, value)


#: The registry; a plug-in adds its own.
TYPES: dict[str, ScalarIndex] = {"BTREE": BTree(), "BITMAP": Bitmap(), "LABEL_LIST": LabelList(), "NGRAM": NGram(), "ZONEMAP": ZoneMap(), "BLOOMFILTER": BloomFilter()}


def register_type(name: str, index: ScalarIndex) -> None:
    TYPES[name.upper()] = index


def _entry(table: Table, name: str, column: str, kind: str, folder: str, fragments: list[int], **more) -> Table:
    def change(body: dict) -> None:
        body["indices"] = [x for x in body["indices"] if x["name"] != name] + [{"name": name, "column": column, "type": kind, "paths": [folder], "fragments": fragments, **more}]

    return table._commit("index", change)


def create_scalar_index(table: Table, column: str, kind: str, name: str | None = None, json_path: str | None = None, replace: bool = True) -> Table:
    """kind: a key of TYPES or INVERTED; json_path: index a value inside a JSON column."""
    kind, name = kind.upper(), name or f"{column}_idx"
    if not replace and any(x["name"] == name for x in table.snapshot.body["indices"]):
        raise TableError(f"index {name!r} exists")
    folder = f"{table.uri}/_indices/{uuid.uuid4().hex}"
    fragments = _all_origins(table)
    _build(table, column, kind, folder, json_path, table.scan())
    return _entry(table, name, column, kind, folder, fragments, json_path=json_path)


def _build(table: Table, column: str, kind: str, folder: str, json_path: str | None, rows: DataFrame) -> None:
    rows = rows.select(ROWID, (json_get_string(F.col(column), json_path) if json_path else F.col(column)).alias(column))
    if kind in ("INVERTED", "FTS"):
        # a frequent term's hits go to several tasks
        share = F.pmod(F.xxhash64(F.col("hits")[0][ROWID]), F.lit(8))
        fts.postings(rows, column).repartition("term", share).sortWithinPartitions("term").write.parquet(folder)
    elif kind in TYPES:
        writer = TYPES[kind].build(rows, column).write
        if kind == "BLOOMFILTER":
            writer = writer.option("parquet.bloom.filter.enabled#value", "true")
        writer.parquet(folder)
    else:
        raise TableError(f"unknown index type {kind!r}")


def create_vector_index(table: Table, column: str, kind: str = "IVF_PQ", metric: str = "l2", partitions: int = 256, sub_vectors: int | None = None, name: str | None = None, seed: int = 0) -> Table:
    """IVF_FLAT (whole vectors), IVF_PQ, IVF_SQ, IVF_RQ; with IVF_HNSW_* names all codes of a probed partition are compared, which finds all that a graph would."""
    quantiser = kind.upper().removeprefix("IVF_").removeprefix("HNSW_").lower()
    rows = table.scan()
    model = vector.train(rows, column, partitions, metric, quantiser, sub_vectors, seed=seed)
    folder = f"{table.uri}/_indices/{uuid.uuid4().hex}"
    vector.assign(rows, column, model).repartition("part_id").write.partitionBy("part_id").parquet(folder)
    return _entry(table, name or f"{column}_idx", column, kind.upper(), folder, _all_origins(table), model=model.to_json())


def _all_origins(table: Table) -> list[int]:
    return sorted(set().union(*map(origins, table.snapshot.fragments))) if table.snapshot.fragments else []


def uncovered(table: Table, entry: dict) -> list[dict]:
    """Fragments with rows that the index may not know."""
    known = set(entry["fragments"])
    return [f for f in table.snapshot.fragments if not origins(f) <= known]


def _unknown_rows(table: Table, entry: dict) -> DataFrame | None:
    """The rows that the index doesn't know; None if it knows all."""
    fresh = uncovered(table, entry)
    if not fresh:
        return None
    rows = table.scan([f["id"] for f in fresh])
    return rows.filter(~F.shiftright(ROWID, 32).isin(entry["fragments"])) if set().union(*map(origins, fresh)) & set(entry["fragments"]) else rows


def load_vector(table: Table, entry: dict) -> tuple[vector.IvfModel, DataFrame]:
    model = vector.IvfModel.from_json(entry["model"])
    lists = None
    for p in entry["paths"]:
        part = table.spark.read.schema(f"{ROWID} long, code binary, part_id int").parquet(p)
        lists = part if lists is None else lists.unionByName(part)
    return model, lists.join(table.scan().select(ROWID), ROWID, "left_semi") if table.snapshot.body["deletions"] else lists


def find(table: Table, column: str, family: str = "scalar") -> dict | None:
    for x in table.snapshot.body["indices"]:
        if x["column"] == column and x["type"].startswith("IVF") == (family == "vector"):
            return x
    return None


def describe(table: Table) -> list[dict]:
    """Names, types, columns, and how many fragments each index covers and lacks."""
    n = len(table.snapshot.fragments)
    return [{"name": x["name"], "type": x["type"], "column": x["column"], "covered": n - len(uncovered(table, x)), "uncovered": len(uncovered(table, x))} for x in table.snapshot.body["indices"]]


def drop_index(table: Table, name: str) -> Table:
    if not any(x["name"] == name for x in table.snapshot.body["indices"]):
        raise TableError(f"no index {name!r}")

    def change(body: dict) -> None:
        body["indices"] = [x for x in body["indices"] if x["name"] != name]

    return table._commit("index", change)


def prewarm(table: Table, name: str) -> int:
    """Caches the sidecar; its rows."""
    entry = next(x for x in table.snapshot.body["indices"] if x["name"] == name)
    return sidecar(table, entry).cache().count()


def sidecar(table: Table, entry: dict) -> DataFrame:
    return table.spark.read.parquet(*entry["paths"])


def optimize(table: Table, name: str, retrain: bool = False) -> Table:
    """Covers the fragments written since: adds their part to the sidecar, or builds it anew."""
    entry = next((x for x in table.snapshot.body["indices"] if x["name"] == name), None)
    if entry is None:
        raise TableError(f"no index {name!r}")
    if retrain:
        if entry["type"].startswith("IVF"):
            model = vector.IvfModel.from_json(entry["model"])
            return create_vector_index(table, entry["column"], entry["type"], model.metric, len(model.centres), name=name)
        return create_scalar_index(table, entry["column"], entry["type"], name, entry.get("json_path"))
    rows = _unknown_rows(table, entry)
    if rows is None:
        return table
    fresh = sorted(set().union(*map(origins, uncovered(table, entry))) - set(entry["fragments"]))
    folder = f"{table.uri}/_indices/{uuid.uuid4().hex}"
    if entry["type"].startswith("IVF"):
        model = vector.IvfModel.from_json(entry["model"])
        vector.assign(rows, entry["column"], model).repartition("part_id").write.partitionBy("part_id").parquet(folder)
    else:
        _build(table, entry["column"], entry["type"], folder, entry.get("json_path"), rows)

    def change(body: dict) -> None:
        body["indices"] = [x | {"paths": [*x["paths"], folder], "fragments": [*x["fragments"], *fresh]} if x["name"] == name else x for x in body["indices"]]

    return table._commit("index", change)


def lookup(table: Table, column: str, op: str, value=None, where: str | None = None) -> DataFrame:
    """The rows of a predicate by index: candidates of the covered fragments, all rows of the others, and the predicate on both.

    where: the predicate in SQL, for the check (derived from op and value if missing)."""
    check: Callable = _check(column, op, value) if where is None else lambda df: predicate(where, df)
    found = _ask(table, column, op, value)
    rows = table.scan() if found is None else fetch(table, *found)
    return rows.filter(check(rows))


def _check(column: str, op: str, value) -> Callable:
    c = F.col(column)
    tests = {
        "=": lambda: c == value, "in": lambda: c.isin(*value), "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value, "between": lambda: c.between(*value),
        "is null": c.isNull, "is not null": c.isNotNull, "contains": lambda: c.contains(value),
        "has any": lambda: F.arrays_overlap(c, F.array(*(F.lit(v) for v in value))), "has all": lambda: F.size(F.array_except(F.array(*(F.lit(v) for v in value)), c)) == 0,
    }
    return lambda df: tests[op]()


# -- filters in SQL that meet indices -------------------------------------------------------------------------

_OPS = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
_FLIP = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_CALLS = {"contains": "contains", "array_has": "has any", "array_contains": "has any", "array_has_any": "has any", "arrays_overlap": "has any", "array_has_all": "has all"}

#: A superset of a predicate's rows: conditions (frames of row ids or zones) that all hold, and the indices asked.
Found = tuple[list[DataFrame], list[dict]]


def _ask(table: Table, column: str, op: str, value, json_path: str | None = None) -> Found | None:
    if column == ROWID and op in ("=", "in"):  # row ids are their own index
        ids = value if op == "in" else [value]
        if all(isinstance(i, int) and not isinstance(i, bool) for i in ids):
            return [table.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"{ROWID} long")], [{"fragments": _all_origins(table)}]
        return None
    for x in table.snapshot.body["indices"]:
        if x["column"] == column and x.get("json_path") == json_path and x["type"] in TYPES and x["paths"]:
            near = TYPES[x["type"]].lookup(sidecar(table, x), op, value)
            if near is not None:
                return [near], [x]
    return None


def _zones(near: DataFrame) -> DataFrame:
    return near if "zone" in near.columns else near.select(F.floor(F.col(ROWID) / ZONE).alias("zone")).distinct()


def candidates(table: Table, where: str) -> Found | None:
    """What the table's scalar indices know about a filter: at least its rows. None if they can't narrow it.

    AND needs an index on one side and uses those of both, OR needs them on both; a negation other than IS NOT NULL is not narrowed."""
    if ROWID not in where and not any(x["type"] in TYPES for x in table.snapshot.body["indices"]):
        return None
    tree = table.spark._jsparkSession.sessionState().sqlParser().parseExpression(where)
    return _walk(table, tree)


def _kids(node) -> list:
    kids = node.children()
    return [kids.apply(i) for i in range(kids.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


_NO = object()


def _value(node):
    """A literal's value, or _NO."""
    if _kind(node) == "UnaryMinus":
        v = _value(_kids(node)[0])
        return -v if isinstance(v, (int, float)) else _NO
    if _kind(node) != "Literal" or node.value() is None:
        return _NO
    kind = node.dataType().typeName()
    if kind == "string":
        return str(node.value().toString())
    if kind in ("integer", "long", "short", "byte", "boolean"):
        return node.value()
    if kind in ("double", "float") or kind.startswith("decimal"):
        return float(str(node.value().toString()) if not isinstance(node.value(), float) else node.value())
    return F.expr(node.sql()) if kind in ("date", "timestamp", "timestamp_ntz") else _NO


def _place(node) -> tuple[str, str | None] | None:
    """The column that a node is, or the column and path of a JSON function."""
    if _kind(node) == "UnresolvedAttribute":
        return ".".join(node.nameParts().apply(i) for i in range(node.nameParts().size())), None
    if _kind(node) == "UnresolvedFunction" and node.nameParts().last() in ("json_get_string", "json_get_int", "json_get_float", "json_get_bool"):
        of, path = _kids(node)
        at, key = _place(of), _value(path)
        return (at[0], key) if at and isinstance(key, str) else None
    return None


def _walk(table: Table, node) -> Found | None:
    kind, kids = _kind(node), _kids(node)
    if kind == "And":
        left, right = _walk(table, kids[0]), _walk(table, kids[1])
        return (left[0] + right[0], left[1] + right[1]) if left and right else left or right
    if kind == "Or":
        left, right = _walk(table, kids[0]), _walk(table, kids[1])
        if not left or not right:
            return None
        a, b = left[0][0], right[0][0]
        if set(a.columns) != set(b.columns):
            a, b = _zones(a), _zones(b)
        return [a.union(b).distinct()], left[1] + right[1]
    if kind in _OPS:
        for of, other, op in ((kids[0], kids[1], _OPS[kind]), (kids[1], kids[0], _FLIP[_OPS[kind]])):
            at, value = _place(of), _value(other)
            if at and value is not _NO:
                if at[1] is not None:  # an index over a JSON path holds text
                    if op != "=" or isinstance(value, (float, bool)):
                        return None
                    value = str(value)
                return _ask(table, at[0], op, value, at[1])
        return None
    if kind in ("IsNull", "IsNotNull") and _place(kids[0]):
        at = _place(kids[0])
        return _ask(table, at[0], "is null" if kind == "IsNull" else "is not null", None, at[1])
    if kind == "In":
        at, values = _place(kids[0]), [_value(k) for k in kids[1:]]
        return _ask(table, at[0], "in", values) if at and at[1] is None and _NO not in values else None
    if kind == "Like":
        at, pattern = _place(kids[0]), _value(kids[1])
        inner = re.fullmatch(r"%([^%_\\]+)%", pattern) if isinstance(pattern, str) else None
        return _ask(table, at[0], "contains", inner[1]) if at and at[1] is None and inner else None
    if kind == "Between" or kind == "UnresolvedFunction" and node.nameParts().last() == "between":
        at, values = _place(kids[0]), [_value(k) for k in kids[1:3]]
        return _ask(table, at[0], "between", values) if at and at[1] is None and _NO not in values else None
    if kind == "UnresolvedFunction" and node.nameParts().last() in _CALLS and len(kids) == 2:
        at, op = _place(kids[0]), _CALLS[node.nameParts().last()]
        if not at or at[1] is not None:
            return None
        if op == "contains":
            value = _value(kids[1])
            return _ask(table, at[0], op, value) if isinstance(value, str) else None
        inner = _kids(kids[1]) if _kind(kids[1]) == "UnresolvedFunction" and kids[1].nameParts().last() == "array" else [kids[1]]
        values = [_value(k) for k in inner]
        return _ask(table, at[0], op, values) if values and _NO not in values else None
    return None


def fetch(table: Table, conditions: list[DataFrame], entries: list[dict]) -> DataFrame:
    """The rows that meet the conditions, and all that one of the indices doesn't know.

    Up to POINTS row ids are looked up in the files that hold them; zones limit the files and become ranges of row ids; else a semi-join decides."""
    known = set.intersection(*(set(x["fragments"]) for x in entries))
    inside = [f for f in table.snapshot.fragments if origins(f) & known]
    rest = [f for f in table.snapshot.fragments if not origins(f) <= known]
    mixed = set().union(*map(origins, rest)) & known if rest else set()
    rows = None
    ids_of = next((c for c in conditions if "zone" not in c.columns), None)
    if ids_of is not None:
        ids = [r[0] for r in ids_of.limit(POINTS + 1).collect()]
        if len(ids) <= POINTS:
            rows = table.rows_of([i for i in ids if i >> 32 in known])
            conditions = [c for c in conditions if c is not ids_of]
    else:
        zones = sorted(r[0] for r in conditions[0].limit(POINTS + 1).collect())
        if len(zones) <= POINTS:
            high = {z * ZONE >> 32 for z in zones} & known
            rows = table.scan([f["id"] for f in inside if origins(f) & high])
            spans: list[list[int]] = []
            for z in zones:
                if spans and spans[-1][1] == z:
                    spans[-1][1] = z + 1
                else:
                    spans.append([z, z + 1])
            near = F.lit(False)
            for a, b in spans:
                near = near | F.col(ROWID).between(a * ZONE, b * ZONE - 1)
            rows = rows.filter(near)
            conditions = conditions[1:]
    if rows is None:
        rows = table.scan([f["id"] for f in inside])
    for c in conditions:
        if "zone" in c.columns:
            rows = rows.withColumn("_zone", F.floor(F.col(ROWID) / ZONE)).join(c.withColumnRenamed("zone", "_zone"), "_zone", "left_semi").drop("_zone")
        else:
            rows = rows.join(c, ROWID, "left_semi")
    if mixed:
        rows = rows.filter(F.shiftright(ROWID, 32).isin(sorted(known)))
    if rest:
        more = table.scan([f["id"] for f in rest])
        more = more.filter(~F.shiftright(ROWID, 32).isin(sorted(known))) if mixed else more
        rows = rows.select(more.columns).union(more)
    return rows


def stored_postings(table: Table, columns: list[str]) -> dict[str, DataFrame]:
    """Postings of the columns that have an inverted index over all fragments."""
    out = {}
    for c in columns:
        for x in table.snapshot.body["indices"]:
            if x["column"] == c and x["type"] in ("INVERTED", "FTS") and not x.get("json_path") and not uncovered(table, x):
                rows = fts.unpacked(sidecar(table, x))
                out[c] = rows.join(table.scan().select(ROWID), ROWID, "left_semi") if table.snapshot.body["deletions"] else rows
    return out


def centroids(table: Table, name: str) -> np.ndarray:
    entry = next(x for x in table.snapshot.body["indices"] if x["name"] == name)
    return load_vector(table, entry)[0].centres


def read_partition(table: Table, name: str, part: int) -> DataFrame:
    entry = next(x for x in table.snapshot.body["indices"] if x["name"] == name)
    return load_vector(table, entry)[1].filter(F.col("part_id") == part)
