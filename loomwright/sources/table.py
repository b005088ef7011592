"""Versioned tables: Parquet fragments under immutable JSON manifests.

A version is a manifest: fields (logical name, physical name, type), fragments (absolute Parquet files with
their row counts), deletion files (Parquet of row ids), configuration, tags and branches beside it. Writers
write data first and commit by creating the next manifest, which only one of them can; the loser reads
what the winner did and rebases if the two operations commute.

Every stored row has `_rowid` (fragment << 32 | place, kept by compaction) and the versions that created and last
updated it. Writers guess the next fragment id and version; a commit that another writer overtook records by how much the
guess was off (`shift`, `planned`, `became` of its fragments), and reading adds it, so ids are never given twice. `origins` of a
fragment are the upper halves of its row ids, if compaction brought rows of other fragments into it.
Reading is one Parquet scan of the files, an anti join with the deletion files of those fragments that lost rows,
and a projection; filters and columns reach the scan.
"""

from __future__ import annotations

import bisect
import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Store

ROWID, ROWADDR, OFFSET, CREATED, UPDATED, SCORE, DISTANCE = "_rowid", "_rowaddr", "_rowoffset", "_row_created_at_version", "_row_last_updated_at_version", "_score", "_distance"
SYSTEM = (ROWID, CREATED, UPDATED)
MAX_ROWS = 1 << 20
#: Row ids that are looked up one by one; more are joined.
POINTS = 1024
#: Row ids that are numbered together; there is a number in memory for each so many rows.
BLOCK = 1 << 18


class TableError(ValueError):
    """A request that the table can't meet."""


class CommitConflict(RuntimeError):
    """Another writer's commit excludes this one."""


#: For a running operation, what it may commit after. Others conflict.
_COMMUTES = {
    "append": {"append", "delete", "update", "rewrite", "index", "config", "merge"},
    "delete": {"append", "index", "config", "delete", "update"},
    "update": {"append", "index", "config", "delete", "update"},
    "overwrite": {"append", "delete", "update", "rewrite", "index", "config", "merge", "overwrite", "restore", "project"},
    "restore": {"append", "delete", "update", "rewrite", "index", "config", "merge", "overwrite", "restore", "project"},
    "rewrite": {"append", "index", "config"},
    "merge": {"config", "index"},
    "project": {"config", "index"},
    "index": {"append", "delete", "update", "index", "config"},
    "config": {"append", "delete", "update", "rewrite", "index", "config", "merge", "project", "overwrite", "restore"},
    "replace": {"append", "config", "index"},
}


@dataclass
class Snapshot:
    """A manifest, as a dictionary with helpers."""

    body: dict[str, Any]

    @property
    def version(self) -> int:
        return self.body["version"]

    @property
    def fields(self) -> list[dict]:
        return self.body["fields"]

    @property
    def fragments(self) -> list[dict]:
        return self.body["fragments"]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f["name"], T._parse_datatype_json_value(f["type"]), f["nullable"], f.get("metadata") or {}) for f in self.fields])

    def physical(self) -> T.StructType:
        own = [T.StructField(f["physical"], T._parse_datatype_json_value(f["type"])) for f in self.fields]
        return T.StructType([*own, *(T.StructField(c, T.LongType()) for c in SYSTEM)])


def _fields(schema: T.StructType) -> list[dict]:
    for f in schema:
        if isinstance(f.dataType, (T.MapType, T.YearMonthIntervalType)):
            raise TableError(f"type {f.dataType.simpleString()} of {f.name} is not supported")
    return [{"id": i, "name": f.name, "physical": f.name, "type": f.dataType.jsonValue(), "nullable": True, "metadata": f.metadata or {}} for i, f in enumerate(schema) if f.name not in SYSTEM]


class Table:
    """One version of a table. Methods that change it commit a new version and move this object there."""

    def __init__(self, spark: SparkSession, uri: str, snapshot: Snapshot, branch: str = "main"):
        self.spark, self.uri, self.snapshot, self.branch = spark, uri.rstrip("/"), snapshot, branch
        self.store = Store(spark, uri)

    # -- opening and versions ------------------------------------------------------------------------

    @staticmethod
    def _folder(branch: str) -> str:
        return "_versions" if branch == "main" else f"_branches/{branch}"

    @classmethod
    def exists(cls, spark: SparkSession, uri: str) -> bool:
        return bool(Store(spark, uri).list("_versions"))

    @classmethod
    def open(cls, spark: SparkSession, uri: str, version: int | str | None = None, asof: float | None = None, branch: str = "main") -> Table:
        """The latest version, that of a number or tag, or the last one not after a time (seconds)."""
        store = Store(spark, uri)
        if isinstance(version, str):
            ref = store.read(f"_tags/{version}.json") if store.exists(f"_tags/{version}.json") else None
            if ref is None:
                raise TableError(f"no tag {version!r}")
            version, branch = ref["version"], ref["branch"]
        names = store.list(cls._folder(branch))
        if not names:
            raise TableError(f"no table at {uri}")
        if version is not None:
            name = f"{version:020d}.json"
            if name not in names:
                raise TableError(f"no version {version}")
            return cls(spark, uri, Snapshot(store.read(f"{cls._folder(branch)}/{name}")), branch)
        read = lambda i: Snapshot(store.read(f"{cls._folder(branch)}/{names[i]}"))
        if asof is None:
            return cls(spark, uri, read(len(names) - 1), branch)
        low, high = 0, len(names)  # times grow with versions: the last one not after `asof` is found by halving
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if read(middle).body["timestamp"] <= asof else (low, middle)
        if low == 0:
            raise TableError(f"no version as of {asof}")
        return cls(spark, uri, read(low - 1), branch)

    def checkout(self, version: int | str | None = None, asof: float | None = None) -> Table:
        return Table.open(self.spark, self.uri, version, asof, self.branch)

    def versions(self) -> list[dict]:
        out = []
        for name in self.store.list(self._folder(self.branch)):
            body = self.store.read(f"{self._folder(self.branch)}/{name}")
            out.append({k: body[k] for k in ("version", "timestamp", "operation")} | {"rows": sum(f["rows"] for f in body["fragments"]) - body["deleted_rows"]})
        return out

    @property
    def version(self) -> int:
        return self.snapshot.version

    @property
    def schema(self) -> T.StructType:
        return self.snapshot.schema()

    # -- commits ----------------------------------------------------------------------------------------

    def _commit(self, operation: str, change: Callable[[dict], None], touched: set[int] | None = None, retries: int = 20) -> Table:
        """Creates the next manifest. change: edits a copy of the newest one; touched: fragments whose rows the operation removes."""
        base = self.snapshot.body
        for attempt in range(retries):
            latest = Table.open(self.spark, self.uri, branch=self.branch).snapshot.body if attempt or self.store.exists(f"{self._folder(self.branch)}/{base['version'] + 1:020d}.json") else base
            for v in range(base["version"] + 1, latest["version"] + 1):
                other = self.store.read(f"{self._folder(self.branch)}/{v:020d}.json")
                clash = other["operation"] not in _COMMUTES[operation]
                if touched and other.get("touched") and operation in ("delete", "update") and touched & set(other["touched"]):
                    clash = True
                if clash:
                    raise CommitConflict(f"{operation} on version {base['version']} meets {other['operation']} of version {v}")
            body = {k: (list(v) if isinstance(v, list) else dict(v) if isinstance(v, dict) else v) for k, v in latest.items()}
            change(body)
            body |= {"version": latest["version"] + 1, "timestamp": time.time(), "operation": operation, "read_version": base["version"], "touched": sorted(touched or ()), "transaction": uuid.uuid4().hex}
            if self.store.create(f"{self._folder(self.branch)}/{body['version']:020d}.json", body):
                self.snapshot = Snapshot(body)
                self._auto_cleanup()
                return self
            time.sleep(min(1.0, 0.02 * 2**attempt))
        raise CommitConflict(f"{operation} lost {retries} races")

    def _auto_cleanup(self) -> None:
        every = int(self.snapshot.body["config"].get("auto_cleanup.interval", 0))
        if every and self.version % every == 0:
            from ..operators.maintain import cleanup

            cleanup(self, older_than=float(self.snapshot.body["config"].get("auto_cleanup.older_than", 14 * 86400)), ignore_tagged=True)

    # -- writing ---------------------------------------------------------------------------------------

    @classmethod
    def write(cls, df: DataFrame, uri: str, mode: str = "create", max_rows_per_file: int = MAX_ROWS, base: str | None = None) -> Table:
        """mode create fails if the table exists; append adds rows of the table's columns; overwrite starts anew."""
        spark = df.sparkSession
        there = cls.exists(spark, uri)
        if mode not in ("create", "append", "overwrite"):
            raise TableError(f"unknown mode {mode!r}")
        if there and mode == "create":
            raise TableError(f"a table exists at {uri}")
        if there:
            table = cls.open(spark, uri)
            if mode == "append":
                return table.append(df, max_rows_per_file)
            return table.overwrite(df, max_rows_per_file)
        empty = {"version": 0, "timestamp": 0.0, "operation": "create", "fields": _fields(df.schema), "fragments": [], "deletions": [], "deleted_rows": 0, "next_fragment": 0, "config": {}, "metadata": {}, "indices": [], "bases": [base] if base else []}
        table = cls(spark, uri, Snapshot(empty))
        fragments = table._write_fragments(df, 1, 0, max_rows_per_file)

        def change(body: dict) -> None:
            body["fragments"] = fragments
            body["next_fragment"] = _next(fragments, 0)

        return table._commit("overwrite", change)

    def _fit(self, df: DataFrame) -> DataFrame:
        """The frame with the table's columns, in order and type; missing ones are null."""
        names = set(df.columns)
        extra = names - {f["name"] for f in self.snapshot.fields} - set(SYSTEM)
        if extra:
            raise TableError(f"columns {sorted(extra)} are not in the table")
        schema = self.schema
        return df.select(*((F.col(f"`{f.name}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema), *(c for c in SYSTEM if c in names))

    def _write_fragments(self, df: DataFrame, version: int, first: int, max_rows: int = MAX_ROWS, keep: bool = False) -> list[dict]:
        """Writes rows as new fragments; with `keep`, ids and versions the frame brings along stay."""
        folder = f"{(self.snapshot.body['bases'] or [self.uri])[-1]}/data/{uuid.uuid4().hex}"
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        part = F.spark_partition_id().cast("long")
        own = F.shiftleft(part + first, 32).bitwiseOR(place)
        have = set(df.columns)
        names = [f["name"] for f in self.snapshot.fields]
        cols = [F.col(f"`{f['name']}`").alias(f["physical"]) for f in self.snapshot.fields]
        cols.append((F.coalesce(ROWID, own) if keep and ROWID in have else own).alias(ROWID))
        cols.append((F.coalesce(CREATED, F.lit(version)) if CREATED in have else F.lit(version)).cast("long").alias(CREATED))
        cols.append((F.coalesce(UPDATED, F.lit(version)) if UPDATED in have else F.lit(version)).cast("long").alias(UPDATED))
        assert set(names) <= have
        df.select(*cols).write.option("maxRecordsPerFile", max_rows).parquet(folder)
        store = Store(self.spark, folder)
        files = [f"{folder}/{n}" for n in store.list("") if n.endswith(".parquet")]
        if not files:
            return []
        written = self.spark.read.schema(self.snapshot.physical()).parquet(*files)
        counts = {r["f"].rsplit("/", 1)[1]: r["n"] for r in written.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
        out: dict[int, dict] = {}
        for f in files:  # a task that wrote several files wrote one fragment: they share the upper half of their row ids
            rows = counts.get(f.rsplit("/", 1)[1], 0)
            if rows:
                i = first + int(f.rsplit("/", 1)[1].split("-")[1])
                have = out.setdefault(i, {"id": i, "files": [], "rows": 0})
                have["files"].append(f)
                have["rows"] += rows
        return list(out.values())

    def append(self, df: DataFrame, max_rows_per_file: int = MAX_ROWS, config: dict[str, str] | None = None) -> Table:
        """Adds rows; `config` entries enter the same commit."""
        first = self.snapshot.body["next_fragment"]
        fragments = self._write_fragments(self._fit(df), self.version + 1, first, max_rows_per_file)
        planned = self.version + 1

        def change(body: dict) -> None:
            place(body, fragments, first, planned)
            body["config"] = body["config"] | (config or {})

        return self._commit("append", change)

    def overwrite(self, df: DataFrame, max_rows_per_file: int = MAX_ROWS) -> Table:
        first, planned = self.snapshot.body["next_fragment"], self.version + 1
        fresh = Table(self.spark, self.uri, Snapshot(self.snapshot.body | {"fields": _fields(df.schema)}), self.branch)
        fragments = fresh._write_fragments(df, planned, first, max_rows_per_file)

        def change(body: dict) -> None:
            body |= {"fields": _fields(df.schema), "fragments": [], "deletions": [], "deleted_rows": 0, "indices": []}
            place(body, fragments, first, planned)

        return self._commit("overwrite", change)

    def write_uncommitted(self, df: DataFrame) -> list[dict]:
        """Fragments written by the executors and not yet part of the table; their ids count from 0 until they are committed."""
        return [f | {"planned": self.version + 1} for f in self._write_fragments(self._fit(df), self.version + 1, 0)]

    def commit_fragments(self, fragments: Sequence[dict]) -> Table:
        """Appends fragments of any number of `write_uncommitted` calls, in one commit."""
        calls: dict[str, list[dict]] = {}
        for f in fragments:
            calls.setdefault(f["files"][0].rpartition("/")[0], []).append(f)

        def change(body: dict) -> None:
            for own in calls.values():
                place(body, own, 0, own[0]["planned"])

        return self._commit("append", change)

    # -- reading ----------------------------------------------------------------------------------------

    def scan(self, fragments: Sequence[int] | None = None, include_deleted: bool = False) -> DataFrame:
        """All rows with the system columns."""
        wanted = None if fragments is None else set(fragments)
        picked = [x for x in self.snapshot.fragments if wanted is None or x["id"] in wanted]
        if not picked:
            return self.spark.createDataFrame([], T.StructType([*self.snapshot.schema(), *(T.StructField(c, T.LongType()) for c in SYSTEM)]))
        lost = {i for d in self.snapshot.body["deletions"] for i in d["fragments"]}
        whole = [x for x in picked if not lost & origins(x)]
        torn = [x for x in picked if lost & origins(x)]
        out = self._read(whole) if whole else None
        if torn:
            part = self._without_deleted(self._read(torn), set().union(*map(origins, torn)), include_deleted)
            out = part if out is None else out.union(part)
        return out

    def _read(self, fragments: list[dict]) -> DataFrame:
        """The rows of fragments, deleted ones too: a scan for all that were committed as planned, and one for each other shift."""
        snap = self.snapshot
        names = [F.col(f"`{f['physical']}`").alias(f["name"]) for f in snap.fields]
        groups: dict[tuple, list[str]] = {}
        for x in fragments:
            groups.setdefault((x.get("shift", 0), x.get("planned", 0), x.get("became", 0)), []).extend(x["files"])
        out = None
        for (shift, planned, became), files in groups.items():
            df = self.spark.read.schema(snap.physical()).parquet(*files)
            system = [F.col(c) for c in SYSTEM]
            if shift:
                system[0] = (F.col(ROWID) + F.lit(shift << 32)).alias(ROWID)
            if planned != became:
                system[1:] = [F.when(F.col(c) == planned, F.lit(became)).otherwise(F.col(c)).cast("long").alias(c) for c in (CREATED, UPDATED)]
            df = df.select(*names, *system)
            out = df if out is None else out.union(df)
        return out

    def _without_deleted(self, df: DataFrame, of: set[int], include_deleted: bool) -> DataFrame:
        paths = [d["path"] for d in self.snapshot.body["deletions"] if of & set(d["fragments"])]
        gone = self.spark.read.schema(f"{ROWID} long").parquet(*paths)
        names = df.columns
        if include_deleted:
            gone = gone.withColumn("_gone", F.lit(True))
            df = df.join(gone, ROWID, "left").withColumn(ROWID, F.when(F.col("_gone").isNull(), F.col(ROWID)))
        else:
            df = df.join(gone, ROWID, "left_anti")
        return df.select(*(F.col(f"`{n}`") for n in names))

    def rows_of(self, ids: Sequence[int]) -> DataFrame:
        """The rows of some row ids, read from the files that can hold them."""
        ids = sorted({int(i) for i in ids})
        high = {i >> 32 for i in ids}
        rows = self.scan([x["id"] for x in self.snapshot.fragments if high & origins(x)])
        return rows.filter(F.col(ROWID).isin(ids))

    def to_df(self, columns: Sequence[str] | None = None) -> DataFrame:
        df = self.scan()
        return df.select(*(columns if columns is not None else [f"`{f['name']}`" for f in self.snapshot.fields]))

    def scanner(self, **options):
        from ..operators.scanner import Scanner

        return Scanner(self, **options)

    def sql(self, query: str, name: str = "dataset", with_row_id: bool = False) -> DataFrame:
        """Spark SQL over the table, registered under `name`. `fts('name', '<query in JSON>')` is a table: the rows that the query finds, with `_score`."""
        from ..functions.register import register, renamed

        register(self.spark)
        df = self.scan()
        (df if with_row_id else df.drop(*SYSTEM)).createOrReplaceTempView(name)
        def searched(m: re.Match) -> str:
            if m[1] != name:
                raise TableError(f"fts() over {m[1]!r}: this session knows {name!r}")
            view = f"_fts_{uuid.uuid4().hex}"
            self.scanner(full_text=m[2].replace("''", "'"), with_row_id=with_row_id).to_df().createOrReplaceTempView(view)
            return view

        query = re.sub(r"\bfts\s*\(\s*'([^']*)'\s*,\s*'((?:[^']|'')*)'\s*\)", searched, query, flags=re.I)
        return self.spark.sql(renamed(query))

    def with_offsets(self, df: DataFrame | None = None) -> DataFrame:
        """Adds `_rowoffset`, the place of each live row in the order of row ids.

        Where no row was deleted or moved, the manifest tells it: the rows of the fragments before, and the row id's own place. Else rows are numbered in blocks of
        `BLOCK` row ids, so that no task sorts a fragment, and a block begins behind all before it."""
        if df is None and not self.snapshot.body["deletions"] and not any(f.get("origins") for f in self.snapshot.fragments):
            begins, total = [], 0
            for f in sorted(self.snapshot.fragments, key=lambda f: f["id"]):
                begins.append((f["id"], total))
                total += f["rows"]
            if len({i for i, _ in begins}) == len(begins):
                before = self.spark.createDataFrame(begins, "_frag long, _before long")
                place = F.col(ROWID).bitwiseAND(F.lit((1 << 32) - 1))
                return self.scan().withColumn("_frag", F.shiftright(ROWID, 32)).join(F.broadcast(before), "_frag").withColumn(OFFSET, F.col("_before") + place).drop("_frag", "_before")
        return numbered(self.scan() if df is None else df)

    def with_addresses(self, df: DataFrame) -> DataFrame:
        """Adds `_rowaddr`: the fragment that holds the row now << 32 | the row's place among that fragment's live rows.

        Without compaction that is the row id; a compacted fragment holds rows of several origins."""
        address = F.col(ROWID)
        moved = [f for f in self.snapshot.fragments if f.get("origins")]
        if not moved:
            return df.withColumn(ROWADDR, address)
        place_in = F.row_number().over(Window.partitionBy("_f").orderBy(ROWID)) - 1
        where = None
        for f in moved:
            part = self.scan([f["id"]]).select(ROWID, F.lit(f["id"]).cast("long").alias("_f"))
            where = part if where is None else where.union(part)
        where = where.select(ROWID, F.shiftleft("_f", 32).bitwiseOR(place_in.cast("long")).alias("_moved"))
        return df.join(where, ROWID, "left").withColumn(ROWADDR, F.coalesce("_moved", address)).drop("_moved")

    def take(self, offsets: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
        """Rows by place; the order and repetitions of `offsets` stay. Where no row was deleted or moved, the manifest tells which fragments hold them."""
        if not self.snapshot.body["deletions"] and not any(f.get("origins") for f in self.snapshot.fragments):
            begins, parts, total = [], sorted(self.snapshot.fragments, key=lambda f: f["id"]), 0
            for f in parts:
                begins.append(total)
                total += f["rows"]
            held = {bisect.bisect_right(begins, int(o)) - 1 for o in offsets if 0 <= o < total}
            frag, before = F.shiftright(ROWID, 32), None
            for i in sorted(held):
                before = (F.when if before is None else before.when)(frag == parts[i]["id"], begins[i])
            if held and len(held) <= 64:
                rows = self.scan([parts[i]["id"] for i in held]).withColumn("_frag", frag).withColumn("_before", before)
                place_in = F.row_number().over(Window.partitionBy("_frag").orderBy(ROWID))
                return self._take(rows.withColumn(OFFSET, F.col("_before") + place_in - 1).drop("_frag", "_before"), OFFSET, offsets, columns)
        return self._take(self.with_offsets(), OFFSET, offsets, columns)

    def take_rows(self, ids: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
        """Rows by id; the order and repetitions of `ids` stay. Up to `POINTS` ids are looked up in the files that can hold them."""
        return self._take(self.rows_of(ids) if len(set(ids)) <= POINTS else self.scan(), ROWID, ids, columns)

    def _take(self, rows: DataFrame, key: str, wanted: Sequence[int], columns: Sequence[str] | None) -> DataFrame:
        want = self.spark.createDataFrame([(i, int(w)) for i, w in enumerate(wanted)], "_pos long, _want long")
        names = list(columns) if columns is not None else [f["name"] for f in self.snapshot.fields]
        near = rows.filter(F.col(key).isin([int(w) for w in set(wanted)])) if key == OFFSET and len(set(wanted)) <= POINTS else rows
        return want.join(near, F.col("_want") == F.col(key)).orderBy("_pos").select(*names)

    def head(self, n: int) -> DataFrame:
        return self.scan().orderBy(ROWID).limit(n).select(*(f"`{f['name']}`" for f in self.snapshot.fields))

    def count_rows(self, predicate: str | None = None) -> int:
        if predicate is None:
            return sum(f["rows"] for f in self.snapshot.fragments) - self.count_deleted_rows()
        return self.scanner(filter=predicate, columns=[]).count()

    def count_deleted_rows(self) -> int:
        return self.snapshot.body["deleted_rows"]

    def count_small_fragments(self, rows: int = MAX_ROWS) -> int:
        return sum(1 for f in self.snapshot.fragments if f["rows"] < rows)

    def column_bytes(self) -> dict[str, int]:
        """Compressed bytes of every column, from the Parquet footers, which the executors open."""
        names = {f["physical"]: f["name"] for f in self.snapshot.fields}
        files = [(f,) for x in self.snapshot.fragments for f in x["files"]]
        if not files:
            return {}

        def read(batches):
            import pyarrow as pa
            import pyarrow.parquet as pq
            from pyarrow import fs

            for batch in batches:
                sizes: dict[str, int] = {}
                for f in batch.column(0).to_pylist():
                    system, path = fs.FileSystem.from_uri(f if "://" in f else "file://" + f.removeprefix("file:"))
                    with system.open_input_file(path) as opened:
                        meta = pq.ParquetFile(opened).metadata
                        for g in range(meta.num_row_groups):
                            for c in range(meta.num_columns):
                                col = meta.row_group(g).column(c)
                                top = col.path_in_schema.split(".")[0]
                                sizes[top] = sizes.get(top, 0) + col.total_compressed_size
                yield pa.RecordBatch.from_pydict({"name": list(sizes), "size": list(sizes.values())}, schema=pa.schema([("name", pa.string()), ("size", pa.int64())]))

        rows = self.spark.createDataFrame(files, "file string").repartition(min(len(files), 1024)).mapInArrow(read, "name string, size long")
        return {names[r["name"]]: r["size"] for r in rows.groupBy("name").agg(F.sum("size").alias("size")).collect() if r["name"] in names}

    def blobs(self, column: str, ids: Sequence[int], start: int = 0, size: int | None = None) -> DataFrame:
        """Bytes (or a part of them) of a binary column by row id, with their whole size."""
        rows = self.take_rows(ids, [ROWID, column])
        part = F.substring(column, start + 1, size) if size is not None else F.expr(f"substring(`{column}`, {start + 1})")
        return rows.select(ROWID, F.octet_length(column).alias("size"), part.alias("bytes"))

    # -- refs --------------------------------------------------------------------------------------------

    def restore(self) -> Table:
        """Makes this version the newest one."""
        keep = self.snapshot.body
        newest = Table.open(self.spark, self.uri, branch=self.branch)

        def change(body: dict) -> None:
            body |= {k: keep[k] for k in ("fields", "fragments", "deletions", "deleted_rows", "indices", "config", "metadata")}

        return newest._commit("restore", change)

    def create_tag(self, name: str, version: int | None = None) -> None:
        ref = {"version": version or self.version, "branch": self.branch}
        self.checkout(ref["version"])
        if not self.store.create(f"_tags/{name}.json", ref):
            raise TableError(f"tag {name!r} exists")

    def update_tag(self, name: str, version: int) -> None:
        if not self.store.exists(f"_tags/{name}.json"):
            raise TableError(f"no tag {name!r}")
        self.store.write(f"_tags/{name}.json", {"version": self.checkout(version).version, "branch": self.branch})

    def delete_tag(self, name: str) -> None:
        if not self.store.exists(f"_tags/{name}.json"):
            raise TableError(f"no tag {name!r}")
        self.store.delete(f"_tags/{name}.json")

    def tags(self) -> dict[str, dict]:
        return {n[:-5]: self.store.read(f"_tags/{n}") for n in self.store.list("_tags")}

    def create_branch(self, name: str) -> Table:
        """A branch that starts at this version and commits by itself."""
        if self.store.list(f"_branches/{name}") or name == "main":
            raise TableError(f"branch {name!r} exists")
        self.store.create(f"_branches/{name}/{self.version:020d}.json", self.snapshot.body | {"parent": self.branch})
        return Table(self.spark, self.uri, self.snapshot, name)

    def branches(self) -> list[str]:
        return ["main", *self.store.list("_branches")]

    def delete_branch(self, name: str) -> None:
        self.store.delete(f"_branches/{name}", True)

    def shallow_clone(self, uri: str) -> Table:
        """A new table over the same files."""
        store = Store(self.spark, uri)
        if store.list("_versions"):
            raise TableError(f"a table exists at {uri}")
        # the source's cleanup must know who else reads its files
        self.store.create(f"_clones/{uuid.uuid4().hex}.json", {"uri": uri.rstrip("/")})
        store.create(f"_versions/{1:020d}.json", self.snapshot.body | {"version": 1, "operation": "clone", "source": self.uri, "bases": [uri]})
        return Table.open(self.spark, uri)

    # -- transactions, changes, metadata -------------------------------------------------------------------

    def transactions(self, after: int = 0, until: int | None = None) -> list[dict]:
        out = []
        for name in self.store.list(self._folder(self.branch)):
            v = int(name[:-5])
            if after < v <= (until or self.version):
                body = self.store.read(f"{self._folder(self.branch)}/{name}")
                out.append({k: body[k] for k in ("version", "operation", "read_version", "timestamp", "transaction")})
        return out

    def inserted(self, begin: int, end: int) -> DataFrame:
        """Rows created in versions (begin, end]."""
        return self.scan().filter((F.col(CREATED) > begin) & (F.col(CREATED) <= end))

    def updated(self, begin: int, end: int) -> DataFrame:
        """Rows there at `begin` and updated in (begin, end]."""
        return self.scan().filter((F.col(CREATED) <= begin) & (F.col(UPDATED) > begin) & (F.col(UPDATED) <= end))

    def update_config(self, values: dict[str, str | None], replace: bool = False, where: str = "config") -> Table:
        """Sets entries of `config` or `metadata`; None removes one."""
        def change(body: dict) -> None:
            body[where] = {k: v for k, v in (({} if replace else body[where]) | values).items() if v is not None}

        return self._commit("config", change)

    def update_field_metadata(self, name: str, values: dict) -> Table:
        def change(body: dict) -> None:
            body["fields"] = [f | {"metadata": f["metadata"] | values} if f["name"] == name else f for f in body["fields"]]

        return self._commit("config", change)

    def add_base(self, path: str) -> Table:
        """From now on data files are written below another root."""
        def change(body: dict) -> None:
            body["bases"] = [*body["bases"], path]

        return self._commit("config", change)

    def validate(self) -> None:
        """Raises if a file is missing, a count is wrong, or a row id stands twice."""
        for f in self.snapshot.fragments:
            for file in f["files"]:
                if not self.store.exists(file):
                    raise TableError(f"missing file {file}")
        rows = self.scan()
        n, distinct = rows.agg(F.count(F.lit(1)), F.countDistinct(ROWID)).first()
        if n != distinct or n != self.count_rows():
            raise TableError(f"{n} rows with {distinct} ids; the manifest says {self.count_rows()}")


def numbered(df: DataFrame) -> DataFrame:
    """Adds `_rowoffset`, the place of each row of the frame in the order of row ids."""
    df = df.withColumn("_block", F.floor(F.col(ROWID) / BLOCK))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy("_block").count().select("_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(ROWID))
    return df.withColumn("_place", place).join(F.broadcast(sizes), "_block").withColumn(OFFSET, F.col("_before") + F.col("_place") - 1).drop("_block", "_before", "_place")


def _next(fragments: list[dict], first: int) -> int:
    return max([first, *(f["id"] + 1 for f in fragments)])


def origins(fragment: dict) -> set[int]:
    """The upper halves of the fragment's row ids."""
    return set(fragment.get("origins") or [fragment["id"]])


def place(body: dict, fragments: list[dict], first: int, planned: int, keep: bool = False) -> list[dict]:
    """Adds fragments that were written as from `first` in version `planned` to the newest manifest, under the ids that are free there.

    keep: their rows have ids of their own already, which stay."""
    shift, became = body["next_fragment"] - first, body["version"] + 1
    out = [f | {"id": f["id"] + shift, "shift": 0 if keep else shift, "planned": planned, "became": became} for f in fragments]
    body["fragments"] = body["fragments"] + out
    body["next_fragment"] = _next(out, body["next_fragment"])
    return out


def as_frame(spark: SparkSession, data: Any, schema: Any = None) -> DataFrame:
    """Frames, pandas, Arrow tables, batches, readers and iterators of batches, lists of dictionaries."""
    import pandas as pd
    import pyarrow as pa

    if isinstance(data, DataFrame):
        return data
    if isinstance(data, pa.RecordBatchReader):
        data = iter(data)
    if isinstance(data, Iterator):  # record-batch readers and generators of batches: spooled to files, not held
        from ..operators.batches import OneShot
        from .store import scratch

        return OneShot(spark, data).to_df(scratch(spark))
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    if isinstance(data, (pd.DataFrame, pa.Table)):
        return spark.createDataFrame(data, schema) if schema is not None else spark.createDataFrame(data)
    rows = list(data)
    if rows and isinstance(rows[0], pa.RecordBatch):
        return spark.createDataFrame(pa.Table.from_batches(rows))
    return spark.createDataFrame(rows, schema)


def column_of(x: str | Column) -> Column:
    return F.expr(x) if isinstance(x, str) else x
