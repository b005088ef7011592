"""Byte-packed exchanges between documents and hash buckets.

Operators on windows have a value for every word or byte of the corpus. A row for each would cost tens
of bytes; here the values that one batch of documents has for one bucket are one row of three arrays:
the documents' ids, how many values each has, and the values in document order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A null id counts as the greatest id.
NULL_ID = (1 << 63) - 1
CELL = "bucket int, kind int, ids binary, counts binary, data binary"
CELL_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("data", pa.binary())])
#: Values that a batch gathers before it packs them.
GATHER = 1_500_000


#: Bytes of text whose values one bucket takes, and the most buckets that an exchange has.
BUCKET_BYTES, MOST = 16 << 20, 1 << 20


def width(docs: DataFrame, text: str = "text") -> int:
    """Buckets of an exchange, a power of two that grows with the table's bytes, so that a task's share stays what it is."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(MOST, 1 << max(2, (-(-total // BUCKET_BYTES) - 1).bit_length()))


def log2(n: int) -> int:
    return n.bit_length() - 1


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def long_id(docs: DataFrame, name: str = "doc_id"):
    """Ids as longs. An order of ids that are no integers has no meaning here, so such a table is refused at once."""
    kind = docs.schema[name].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{name} must be an integer, not {kind.simpleString()}")
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return starts, np.diff(np.append(starts, len(sorted_values)))


def cells(buckets: np.ndarray, docs: np.ndarray, ids: np.ndarray, values: np.ndarray, kind: int) -> Iterator[dict]:
    """Rows of CELL. docs: the place of each value's document in `ids`, ascending."""
    order = np.argsort(buckets.astype(np.uint16) if len(buckets) == 0 or int(buckets.max()) < 1 << 16 else buckets, kind="stable")
    sorted_buckets = buckets[order]
    for start, n in zip(*runs(sorted_buckets)):
        pick = order[start : start + n]
        first, count = runs(docs[pick])
        yield {"bucket": int(sorted_buckets[start]), "kind": kind, "ids": ids[docs[pick[first]]].tobytes(), "counts": count.astype(np.uint32).tobytes(), "data": values[pick].tobytes()}


def batch_of(rows: list[dict], schema: pa.Schema = CELL_ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted table."""
    if len(table) == 0 or len(values) == 0:
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


class Sieve:
    """A sorted table of 32-bit values behind a bitmap that turns most misses away."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = max(16, min(24, int(len(table)).bit_length() + 4))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[table >> np.uint32(32 - self.bits)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values that occur, and their places in the table."""
        near = np.flatnonzero(self.map[values >> np.uint32(32 - self.bits)])
        if len(near) == 0:
            return near, near
        at = np.searchsorted(self.table, values[near])
        at[at == len(self.table)] = 0
        ok = self.table[at] == values[near]
        return near[ok], at[ok]


def by_bucket(df, buckets: int):
    """The cells of a bucket in one partition, kinds in order."""
    return df.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")


def bucket_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bytes]]:
    """The cells of `by_bucket` one after the other: bucket, kind, ids, counts, data."""
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, kind, ids, counts, data = (batch.column(k)[i] for k in range(5))
            yield bucket.as_py(), kind.as_py(), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.uint32), data.as_buffer()
