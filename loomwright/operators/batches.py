"""Rows by ranges and in batches: what a training loop or a service reads from a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.table import OFFSET, POINTS, ROWID, Table, TableError


def take_ranges(table: Table, ranges: Sequence[tuple[int, int]], columns: Sequence[str] | None = None) -> DataFrame:
    """The rows whose places lie in [start, stop) of each range, in the order of the ranges; overlapping ranges repeat rows."""
    if any(a < 0 or b < a for a, b in ranges):
        raise TableError("ranges must not be negative or end before they start")
    rows = table.with_offsets()
    want = table.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "_i long, _a long, _b long")
    names = list(columns) if columns is not None else [f.name for f in table.schema]
    near = F.lit(False)
    for a, b in ranges[:POINTS]:
        near = near | F.col(OFFSET).between(a, b - 1)
    found = (rows.filter(near) if len(ranges) <= POINTS else rows).join(F.broadcast(want), (F.col(OFFSET) >= F.col("_a")) & (F.col(OFFSET) < F.col("_b")))
    return found.orderBy("_i", OFFSET).select(*(f"`{n}`" for n in names))


def fetch_columns(table: Table, found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds columns of the table to a frame of row ids (and what else it has): few ids are looked up in the files that hold them, many are joined."""
    ids = [r[0] for r in found.select(ROWID).distinct().limit(POINTS + 1).collect()]
    rows = table.rows_of(ids) if len(ids) <= POINTS else table.scan()
    return found.join(rows.select(ROWID, *(f"`{c}`" for c in columns)), ROWID)


def strict_batches(df: DataFrame, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of exactly `size` rows (the last may be smaller), fetched partition by partition."""
    if size <= 0:
        raise TableError("a batch has one row at least")
    rows, schema = [], df.limit(0).toArrow().schema
    for row in df.toLocalIterator(prefetchPartitions=True):
        rows.append(row.asDict(recursive=True))
        if len(rows) == size:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def groups(df: DataFrame, column: str) -> Iterator[tuple[object, DataFrame]]:
    """A frame split on one column: every value with its rows, in the order of values; nothing but the values is fetched."""
    for r in df.select(column).distinct().orderBy(F.col(column).asc_nulls_last()).toLocalIterator():
        yield r[0], df.filter(F.col(column).eqNullSafe(F.lit(r[0])))


class FragmentSession:
    """One fragment, cached for repeated takes."""

    def __init__(self, table: Table, fragment: int):
        if fragment not in {f["id"] for f in table.snapshot.fragments}:
            raise TableError(f"no fragment {fragment}")
        self.names = [f.name for f in table.schema]
        self.rows = table.with_offsets(table.scan([fragment])).cache()

    def take(self, places: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
        want = self.rows.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(places)], "_pos long, _want long")
        return want.join(self.rows, F.col("_want") == F.col(OFFSET)).orderBy("_pos").select(*(columns or self.names))

    def close(self) -> None:
        self.rows.unpersist()


class OneShot:
    """A stream of Arrow batches that can be read once; a second read is an error."""

    def __init__(self, spark: SparkSession, batches: Iterator[pa.RecordBatch] | pa.RecordBatchReader):
        self.spark, self.batches = spark, batches

    def to_df(self, folder: str, rows: int = 1 << 16) -> DataFrame:
        """Spools the stream to Parquet files below `folder`, some rows at a time, and gives a frame over them."""
        if self.batches is None:
            raise TableError("the stream has been read")
        batches, self.batches = self.batches, None
        held: list[pa.RecordBatch] = []
        schema = None

        def spool() -> None:
            nonlocal schema
            part = self.spark.createDataFrame(pa.Table.from_batches(held))
            schema = part.schema
            part.coalesce(1).write.mode("append").parquet(folder)
            held.clear()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= rows:
                spool()
        if held:
            spool()
        if schema is None:
            raise TableError("the stream has no batch")
        return self.spark.read.schema(schema).parquet(folder)


def vec_to_table(spark: SparkSession, vectors: np.ndarray | dict, names: tuple[str, str] = ("id", "vector")) -> DataFrame:
    """A frame of ids and float vectors from a matrix (ids are row numbers) or a mapping."""
    items = list(vectors.items()) if isinstance(vectors, dict) else list(enumerate(np.asarray(vectors)))
    sizes = {len(v) for _, v in items}
    if len(sizes) > 1:
        raise TableError(f"vectors of {sorted(sizes)} dimensions")
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in items], f"{names[0]} {'long' if not items or isinstance(items[0][0], (int, np.integer)) else 'string'}, {names[1]} array<float>")


def validate_vector_index(table: Table, column: str, sample: int = 64, k: int = 10, nprobes: int = 20, refine: int = 10, least: float = 0.9) -> float:
    """The recall of a vector index over a seeded sample of the table's own vectors; below `least` is an error."""
    from . import indices, vector

    entry = indices.find(table, column, "vector")
    if entry is None:
        raise TableError(f"{column} has no vector index")
    model, lists = indices.load_vector(table, entry)
    rows = table.scan()
    asked = rows.filter(F.col(column).isNotNull()).orderBy(F.xxhash64(ROWID)).limit(sample).select(F.col(ROWID).alias("qid"), column)
    truth = vector.batch(rows, column, asked, "qid", column, k, model.metric).select("qid", ROWID)
    found = vector.search_batch(rows, lists, model, column, asked, "qid", column, k, nprobes, refine).select("qid", ROWID, F.lit(1).alias("hit"))
    recall = truth.join(found, ["qid", ROWID], "left").agg(F.count("hit") / F.count(F.lit(1))).first()[0] or 0.0
    if recall < least:
        raise TableError(f"recall {recall:.3f} is below {least}")
    return recall


def cast_list_f16(df: DataFrame, column: str) -> DataFrame:
    """The list column with its values rounded to half precision (kept as floats, which Spark has)."""
    schema = df.schema
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at)
            half = col.values.cast(pa.float32()).to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
            values = pa.array(half, mask=np.asarray(col.values.is_null())).cast(col.type.value_type)
            lists = type(col).from_arrays(col.offsets, values, mask=col.is_null()) if col.null_count else type(col).from_arrays(col.offsets, values)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], lists, *b.columns[at + 1 :]], names=b.schema.names)

    return df.mapInArrow(run, schema)
