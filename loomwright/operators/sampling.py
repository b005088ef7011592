"""Samples, and the samplers that deal a table out to training processes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.table import OFFSET, ROWID, Table, numbered


def sample(table: Table, n: int, seed: int = 0, columns=None) -> DataFrame:
    """n rows without replacement: the least seeded hashes, a top-k without a full sort."""
    rows = table.scan()
    names = list(columns) if columns else [f.name for f in table.schema]
    return rows.orderBy(F.xxhash64(ROWID, F.lit(seed)), ROWID).limit(n).select(*names)


def maybe_sample(table: Table, n: int, column: str, seed: int = 0) -> DataFrame:
    """All non-null values if there are no more than n, else a sample of n."""
    rows = table.scan().filter(F.col(column).isNotNull())
    total = rows.count()
    if total <= n:
        return rows.select(column)
    near = rows.sample(min(1.0, 1.5 * n / total + 10 / total), seed) if total > 10 * n else rows
    return near.orderBy(F.xxhash64(ROWID, F.lit(seed))).limit(n).select(column)


def reservoir(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows of any frame."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k)


def sharded_fragments(table: Table, rank: int, world: int) -> DataFrame:
    """The fragments whose place is rank modulo world."""
    ids = [f["id"] for i, f in enumerate(table.snapshot.fragments) if i % world == rank]
    return table.scan(ids).drop("_row_created_at_version", "_row_last_updated_at_version")


def sharded_batches(table: Table, batch: int, rank: int, world: int, seed: int | None = None, epoch: int = 0, where: str | None = None) -> DataFrame:
    """Batches of consecutive rows, dealt round-robin: `_batch` numbers them. A seed shuffles the batches, another way each epoch. Every row goes to one rank."""
    df = table.with_offsets()
    if where is not None:
        df = numbered(df.filter(where))
    df = df.withColumn("_batch", F.floor(F.col(OFFSET) / batch))
    deal = F.col("_batch") if seed is None else F.xxhash64("_batch", F.lit(seed), F.lit(epoch))
    return df.filter(F.pmod(deal, F.lit(world)) == rank)


def sharded_fixed_batches(table: Table, batch: int, rank: int, world: int) -> DataFrame:
    """As `sharded_batches`, but every rank gets the same number of whole batches."""
    whole = table.count_rows() // batch // world * world
    return sharded_batches(table, batch, rank, world).filter(F.col("_batch") < whole)
