"""Streams into and out of versioned tables, and the log of write-ahead regions.

Each micro-batch is one commit, which also enters the stream's batch number into the table's configuration. So a batch that a
restarted stream sends again is recognised and skipped: appends and merges happen once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutate import MergeInsert
from ..sources.table import Table, TableError


def once(table_uri: str, name: str, act: Callable[[Table, DataFrame, dict[str, str]], None]):
    """A function for foreachBatch: `act` gets the table, the batch, and the configuration that its commit must carry."""
    def batch(df: DataFrame, number: int) -> None:
        table = Table.open(df.sparkSession, table_uri)
        key = f"stream.{name}.batch"
        if int(table.snapshot.body["config"].get(key, -1)) >= number:
            return
        act(table, df, {key: str(number)})

    return batch


def append_stream(stream: DataFrame, table_uri: str, checkpoint: str, name: str = "default", **trigger) -> StreamingQuery:
    return stream.writeStream.foreachBatch(once(table_uri, name, lambda t, df, config: t.append(df, config=config))).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def upsert_stream(stream: DataFrame, table_uri: str, on: str, checkpoint: str, order: str | None = None, name: str = "default", **trigger) -> StreamingQuery:
    """Merges every micro-batch; of several rows of a key in a batch the greatest `order` counts."""
    def act(table: Table, df: DataFrame, config: dict[str, str]) -> None:
        if order is not None:
            rest = [c for c in df.columns if c != on]
            df = df.groupBy(on).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(on, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)
        MergeInsert(table, on).when_matched_update_all().when_not_matched_insert_all().execute(df, config)

    return stream.writeStream.foreachBatch(once(table_uri, name, act)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def poll_changes(table: Table, since: int) -> tuple[int, DataFrame, DataFrame]:
    """The newest version, and the rows inserted and updated after `since`."""
    now = Table.open(table.spark, table.uri, branch=table.branch)
    return now.version, now.inserted(since, now.version), now.updated(since, now.version)


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], late: str = "10 minutes", **aggregates) -> DataFrame:
    """Windowed aggregates of a stream or table of events, with a watermark for late rows."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    return df.groupBy(F.window(time, width), *keys).agg(*(F.expr(sql).alias(n) for n, sql in aggregates.items()))


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    df = events.withWatermark(time, late) if events.isStreaming else events
    return df.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("events"))


_NEXT = {"open": "sealed", "sealed": "flushed", "flushed": "merged"}


class WriteAheadRegions:
    """Bookkeeping of write-ahead-log regions in a table's metadata: generations with an owner, open -> sealed -> flushed -> merged."""

    def __init__(self, table: Table):
        self.table = table

    def _all(self) -> dict[str, dict]:
        import json

        return json.loads(self.table.snapshot.body["metadata"].get("wal", "{}"))

    def _edit(self, act: Callable[[dict[str, dict]], object]):
        """Applies `act` to the newest state in the commit itself: of two writers, the later one sees what the first did."""
        import json

        result = []

        def change(body: dict) -> None:
            regions = json.loads(body["metadata"].get("wal", "{}"))
            result[:] = [act(regions)]
            body["metadata"] = body["metadata"] | {"wal": json.dumps(regions)}

        self.table._commit("config", change)
        return result[0]

    def advance(self, region: str, owner: str) -> int:
        """Seals the region's newest generation and opens the next."""
        def act(regions: dict[str, dict]) -> int:
            log = regions.setdefault(region, {"generations": []})["generations"]
            if log and log[-1]["state"] == "open":
                log[-1]["state"] = "sealed"
            log.append({"generation": len(log), "owner": owner, "state": "open"})
            return len(log) - 1

        return self._edit(act)

    def move(self, region: str, generation: int, owner: str) -> str:
        """The generation's next state; only its owner may move it."""
        def act(regions: dict[str, dict]) -> str:
            entry = regions[region]["generations"][generation]
            if entry["owner"] != owner:
                raise TableError(f"{region}/{generation} belongs to {entry['owner']}")
            if entry["state"] not in _NEXT:
                raise TableError(f"{region}/{generation} is {entry['state']}")
            entry["state"] = _NEXT[entry["state"]]
            return entry["state"]

        return self._edit(act)

    def trim(self) -> int:
        """Forgets generations that are merged; their number."""
        def act(regions: dict[str, dict]) -> int:
            fresh = [g for r in regions.values() for g in r["generations"] if g["state"] == "merged" and not g.get("trimmed")]
            for g in fresh:
                g["trimmed"] = True
            return len(fresh)

        return self._edit(act)

    def states(self) -> dict[str, list[str]]:
        return {k: [g["state"] for g in r["generations"]] for k, r in self._all().items()}
