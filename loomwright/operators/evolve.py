"""Schema evolution: adding, altering and dropping columns. What can be done in the manifest moves no data."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import cast_type, expression
from ..sources.table import MAX_ROWS, SYSTEM, Snapshot, Table, TableError, _fields, origins, place

_FAMILIES = (
    (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType), (T.StringType, T.VarcharType, T.CharType), (T.BinaryType,),
    (T.DecimalType,), (T.TimestampType, T.TimestampNTZType), (T.DateType,),
)


def rewrite(table: Table, rows: DataFrame, operation: str, changed: set[str] | None = None, max_rows: int = MAX_ROWS) -> Table:
    """Replaces all data by rows that keep their ids and versions, under the frame's columns. Indices over `changed` columns, and over columns that are gone, go."""
    data = rows.drop(*SYSTEM)
    first, planned = table.snapshot.body["next_fragment"], table.version + 1
    fresh = Table(table.spark, table.uri, Snapshot(table.snapshot.body | {"fields": _fields(data.schema)}), table.branch)
    came = sorted(set().union(*map(origins, table.snapshot.fragments))) if table.snapshot.fragments else []
    fragments = [f | {"origins": came} for f in fresh._write_fragments(rows, planned, first, max_rows, keep=True)]
    stay = set(data.columns) - (changed or set())

    def change(body: dict) -> None:
        body |= {"fields": _fields(data.schema), "fragments": [], "deletions": [], "deleted_rows": 0, "indices": [x for x in body["indices"] if x["column"] in stay]}
        place(body, fragments, first, planned, keep=True)

    return table._commit(operation, change)


def _new(table: Table, names: Sequence[str]) -> None:
    clash = set(names) & {f.name for f in table.schema}
    if clash:
        raise TableError(f"columns {sorted(clash)} exist")


def _project(table: Table, change_fields: Callable[[list[dict]], list[dict]], renames: Mapping[str, str | None] | None = None) -> Table:
    """Changes the manifest's fields; indices follow `renames`, and go with columns that it maps to None."""
    def change(body: dict) -> None:
        body["fields"] = change_fields(body["fields"])
        to = [(x, (renames or {}).get(x["column"], x["column"])) for x in body["indices"]]
        body["indices"] = [x | {"column": name} for x, name in to if name is not None]

    return table._commit("project", change)


def add_columns(table: Table, columns: Mapping[str, str]) -> Table:
    """Columns of SQL expressions. Typed nulls (`cast(null as T)`) only enter the manifest."""
    import re

    _new(table, list(columns))
    nulls = {n: re.fullmatch(r"\s*cast\s*\(\s*null\s+as\s+([\w(), <>:]+)\)\s*", sql, re.I) for n, sql in columns.items()}
    if all(nulls.values()):
        return add_null_columns(table, T.StructType([T.StructField(n, T._parse_datatype_string(m[1].strip())) for n, m in nulls.items()]))
    rows = table.scan()
    return rewrite(table, rows.select(*rows.columns, *(expression(sql, rows).alias(n) for n, sql in columns.items())), "merge")


def add_null_columns(table: Table, schema: T.StructType) -> Table:
    """Nullable columns without a value, in the manifest alone."""
    _new(table, schema.names)
    if any(not f.nullable for f in schema):
        raise TableError("a column without values must be nullable")

    def fields(old: list[dict]) -> list[dict]:
        # a physical name is never used twice: a dropped column must not come back
        used = len(old) + table.version * 1000
        return [*old, *(f | {"id": used + i, "physical": f"{f['name']}__{used + i}"} for i, f in enumerate(_fields(schema)))]

    return _project(table, fields)


def add_columns_udf(table: Table, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType, read: Sequence[str] | None = None) -> Table:
    """Columns that a function of Arrow batches computes; it must give a row for every row."""
    _new(table, schema.names)
    rows = table.scan()
    names = list(read) if read is not None else [f.name for f in table.schema]

    def run(batches):
        for b in batches:
            out = function(b.select(names))
            if out.num_rows != b.num_rows:
                raise ValueError(f"a batch of {b.num_rows} rows became {out.num_rows}")
            yield pa.RecordBatch.from_arrays([*b.columns, *(out.column(out.schema.get_field_index(n)) for n in schema.names)], [*b.schema.names, *schema.names])

    return rewrite(table, rows.mapInArrow(run, T.StructType([*rows.schema, *schema])), "merge")


def add_columns_from(table: Table, data: DataFrame, order: str) -> Table:
    """Columns of a frame that has a row for every row of the table, paired by place; `order` sorts the frame."""
    from pyspark.sql import Window

    _new(table, [c for c in data.columns if c != order])
    # sorted in ranges, numbered within each: no task sees the whole frame
    draft = f"{table.uri}/_drafts/{uuid.uuid4().hex}"
    data.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).write.parquet(draft)
    data = table.spark.read.parquet(draft)
    sizes = data.groupBy("_part").count()
    sizes = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = data.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(order))).join(F.broadcast(sizes), "_part").withColumn("_place", F.col("_before") + F.col("_in") - 1).drop("_in", "_before")
    data = data.drop("_part")
    rows = table.with_offsets()
    if data.count() != table.count_rows():
        raise TableError("the frame must have as many rows as the table")
    add = [c for c in data.columns if c not in table.schema.names]
    joined = rows.join(numbered.select("_place", *add), rows["_rowoffset"] == numbered["_place"], "left")
    done = rewrite(table, joined.select(*[f.name for f in table.schema], *add, *SYSTEM), "merge")
    table.store.delete(draft, True)
    return done


def alter_columns(table: Table, *changes: Mapping) -> Table:
    """changes: {path, name (new name), nullable, type}. A type changes within its family only."""
    casts: dict[str, T.DataType] = {}
    renames: dict[str, str] = {}
    nullable: dict[str, bool] = {}
    types = {f.name: f.dataType for f in table.schema}
    for c in changes:
        path = c["path"]
        if path not in types:
            raise TableError(f"no column {path!r}")
        if "type" in c:
            to = c["type"] if isinstance(c["type"], T.DataType) else T._parse_datatype_string(cast_type(c["type"]))
            if not any(isinstance(types[path], f) and isinstance(to, f) for f in _FAMILIES):
                raise TableError(f"{path} can't change from {types[path].simpleString()} to {to.simpleString()}")
            casts[path] = to
        if "name" in c:
            _new(table, [c["name"]])
            renames[path] = c["name"]
        if "nullable" in c:
            if not c["nullable"] and table.scan().filter(F.col(path).isNull()).limit(1).count():
                raise TableError(f"{path} holds nulls")
            nullable[path] = c["nullable"]
    if casts:
        rows = table.scan()
        rewrite(table, rows.select(*(F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(f"`{c}`") for c in rows.columns)), "merge", set(casts))
    if renames or nullable:
        _project(table, lambda old: [f | {"name": renames.get(f["name"], f["name"]), "nullable": nullable.get(f["name"], f["nullable"])} for f in old], renames)
    return table


def drop_columns(table: Table, names: Sequence[str]) -> Table:
    """Whole columns leave the manifest; fields of structs are rewritten."""
    have = {f.name for f in table.schema}
    whole = [n for n in names if n in have]
    nested = [n for n in names if n not in have]
    for n in nested:
        top, _, rest = n.partition(".")
        if top not in have or not rest:
            raise TableError(f"no column {n!r}")
    if nested:
        rows = table.scan()
        for n in nested:
            top, _, rest = n.partition(".")
            rows = rows.withColumn(top, F.col(top).dropFields(rest))
        rewrite(table, rows, "merge", {n.partition(".")[0] for n in nested})
    if whole:
        if set(whole) == have:
            raise TableError("a table keeps one column at least")
        _project(table, lambda old: [f for f in old if f["name"] not in whole], {n: None for n in whole})
    return table
