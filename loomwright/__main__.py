"""Command line: inspect a table, query it in SQL, build an index.

    python -m loomwright inspect URI
    python -m loomwright query URI "SELECT count(*) FROM dataset"
    python -m loomwright index URI COLUMN KIND
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomwright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("inspect").add_argument("uri")
    ask = commands.add_parser("query")
    ask.add_argument("uri")
    ask.add_argument("sql")
    build = commands.add_parser("index")
    build.add_argument("uri")
    build.add_argument("column")
    build.add_argument("kind")
    build.add_argument("--partitions", type=int, default=256)
    build.add_argument("--metric", default="l2")
    a = parser.parse_args(args)
    from .operators import indices
    from .sources.table import Table

    spark = spark or SparkSession.builder.appName("loomwright").getOrCreate()
    table = Table.open(spark, a.uri)
    if a.command == "inspect":
        print(json.dumps({"version": table.version, "rows": table.count_rows(), "fragments": len(table.snapshot.fragments), "schema": table.schema.simpleString(), "indices": indices.describe(table), "tags": table.tags()}))
    elif a.command == "query":
        for row in table.sql(a.sql).toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=str))
    elif a.kind.upper().startswith("IVF"):
        indices.create_vector_index(table, a.column, a.kind, a.metric, a.partitions)
    else:
        indices.create_scalar_index(table, a.column, a.kind)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
