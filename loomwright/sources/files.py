"""Single files, TFRecord files, and generated tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_file(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None, rows: list[int] | None = None) -> DataFrame:
    """One Parquet file: all of it, a range of rows, or rows by place."""
    df = spark.read.parquet(path)
    if start is None and rows is None:
        return df
    place = F.col("_metadata.row_index")
    numbered = df.withColumn("_row", place)
    if rows is not None:
        want = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "_pos int, _row long")
        return want.join(numbered.filter(F.col("_row").isin(rows)), "_row").orderBy("_pos").drop("_row", "_pos")
    return numbered.filter((F.col("_row") >= start) & (F.col("_row") < (stop if stop is not None else 1 << 62))).drop("_row")


def write_file(df: DataFrame, path: str) -> None:
    """One Parquet file (in a folder of its own)."""
    df.coalesce(1).write.parquet(path)


# -- TFRecord: length, CRC, a protobuf tf.train.Example, CRC ------------------------------------------------


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 0x7F) << shift
        i += 1
        if b[i - 1] < 0x80:
            return out, i
        shift += 7


def _message(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
            yield tag >> 3, v
        elif kind == 2:
            n, i = _varint(b, i)
            yield tag >> 3, b[i : i + n]
            i += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, b[i : i + n]
            i += n


def parse_example(record: bytes) -> dict[str, list]:
    """Features of a serialized example: bytes, floats or integers."""
    out: dict[str, list] = {}
    for _, features in _message(record):
        for _, entry in _message(features):
            name, feature = "", b""
            for k, v in _message(entry):
                if k == 1:
                    name = v.decode()
                else:
                    feature = v
            values: list = []
            for kind, body in _message(feature):
                for k, v in _message(body):
                    if kind == 1:
                        values.append(v)
                    elif kind == 2:
                        values += struct.unpack(f"<{len(v) // 4}f", v)
                    elif isinstance(v, int):
                        values.append(v - (1 << 64) if v >> 63 else v)
                    else:
                        i = 0
                        while i < len(v):
                            x, i = _varint(v, i)
                            values.append(x - (1 << 64) if x >> 63 else x)
            out[name] = values
    return out


def records(content: bytes) -> Iterator[bytes]:
    i = 0
    while i + 12 <= len(content):
        (n,) = struct.unpack_from("<Q", content, i)
        yield content[i + 12 : i + 12 + n]
        i += 16 + n


def infer_tfrecord_schema(spark: SparkSession, path: str, sample: int = 100) -> T.StructType:
    """A column per feature of the first records; lists where a record holds more than one value."""
    first = spark.read.format("binaryFile").load(path).select("content").first()
    kinds: dict[str, T.DataType] = {}
    many: set[str] = set()
    for i, r in enumerate(records(bytes(first[0])) if first else ()):
        if i >= sample:
            break
        for name, values in parse_example(r).items():
            if values:
                kinds[name] = T.LongType() if isinstance(values[0], int) else T.FloatType() if isinstance(values[0], float) else T.BinaryType()
            if len(values) > 1:
                many.add(name)
    return T.StructType([T.StructField(n, T.ArrayType(k) if n in many else k) for n, k in sorted(kinds.items())])


def read_tfrecord(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of TFRecord files, a task per file."""
    import pandas as pd

    schema = schema or infer_tfrecord_schema(spark, path)
    lists = {f.name for f in schema if isinstance(f.dataType, T.ArrayType)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for r in records(bytes(content)):
                    e = parse_example(r)
                    rows.append({n: e.get(n) if n in lists else (e.get(n) or [None])[0] for n in schema.names})
                yield pd.DataFrame(rows, columns=schema.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


# -- generated columns -----------------------------------------------------------------------------------


def generate(spark: SparkSession, rows: int, seed: int = 0, **columns: str) -> DataFrame:
    """Deterministic tables: step, int, double, string, bool, category:n or vector:d per column."""
    out = spark.range(rows)
    cols = []
    for i, (name, kind) in enumerate(columns.items()):
        base, _, arg = kind.partition(":")
        h = F.xxhash64(F.col("id"), F.lit(seed), F.lit(i))
        unit = F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
        made = {
            "step": lambda: F.col("id"), "int": lambda h=h: F.pmod(h, F.lit(1 << 31)), "double": lambda u=unit: u, "string": lambda h=h: F.hex(h), "bool": lambda h=h: F.pmod(h, F.lit(2)) == 0,
            "category": lambda h=h, a=arg: F.concat(F.lit("c"), F.pmod(h, F.lit(int(a or 10)))),
            "vector": lambda i=i, a=arg: F.transform(F.sequence(F.lit(1), F.lit(int(a or 8))), lambda k: (F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), F.lit(i), k), 11).cast("double") / float(1 << 53)).cast("float")),
        }
        cols.append(made[base]().alias(name))
    return out.select(*cols)
