"""Shared plumbing of the training-data operators: sessions, tables, lineage cuts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may fall back on a temporary one."""
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Writes `df` below the shared folder and reads it back: lineage ends there, and losing an executor costs nothing.

    With `free`, the shuffle files that only led there are given back at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    if free:  # Spark deletes them once the driver has collected the plans that refer to them
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone by now
        pass


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in have:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def slices(spark: SparkSession, floor: int = 8) -> int:
    """Shuffle width for byte-packed exchanges: the session's own, never under `floor`."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))
