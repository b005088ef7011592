"""The registered queries of the engine, each beside the SQL that an independent engine runs for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import engineq, sqlq

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of a versioned table: SQL filter, expression projection, order with nulls last, slice."""
    return engineq.scan_project_expr(spark, sf_dir)


def queries() -> dict[str, Query]:
    return sqlq.queries() | engineq.queries()


def oracle_sql() -> dict[str, str]:
    return sqlq.oracle_sql() | engineq.oracle_sql()
