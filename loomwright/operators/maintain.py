"""Compaction and cleanup."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import functions as F

from ..sources.store import Store
from ..sources.table import MAX_ROWS, ROWID, Table, TableError, origins, place


@dataclass(frozen=True)
class CompactionTask:
    """Neighbouring fragments that become one group of files."""

    fragments: tuple[int, ...]
    rows: int


def plan_compaction(table: Table, target_rows: int = MAX_ROWS, max_deleted: float = 0.1) -> list[CompactionTask]:
    """Runs of small fragments, and fragments of which more than a tenth is deleted."""
    paths = [d["path"] for d in table.snapshot.body["deletions"]]
    gone = table.spark.read.schema(f"{ROWID} long").parquet(*paths) if paths else None
    deleted = {r[0]: r[1] for r in gone.groupBy(F.shiftright(ROWID, 32)).count().collect()} if gone is not None else {}
    tasks: list[CompactionTask] = []
    run: list[tuple[int, int, int]] = []

    def close() -> None:
        if len(run) > 1 or any(holes for _, _, holes in run):
            tasks.append(CompactionTask(tuple(i for i, _, _ in run), sum(n for _, n, _ in run)))
        run.clear()

    for f in table.snapshot.fragments:
        holes = min(f["rows"], sum(deleted.get(i, 0) for i in origins(f)))
        live = f["rows"] - holes
        if f["rows"] < target_rows or holes > max_deleted * f["rows"]:
            if run and sum(n for _, n, _ in run) + live > target_rows:
                close()
            run.append((f["id"], live, holes))
        else:
            close()
    close()
    return tasks


def run_compaction(table: Table, task: CompactionTask, target_rows: int = MAX_ROWS) -> dict:
    """Writes the task's live rows anew; ids and versions stay. Any worker may run it; `commit_compaction` makes it count."""
    rows = table.scan(task.fragments)
    files = max(1, -(-task.rows // target_rows))
    came = sorted(set().union(*(origins(f) for f in table.snapshot.fragments if f["id"] in task.fragments)))
    new = table._write_fragments(rows.coalesce(files), table.version, 0, target_rows, keep=True)
    return {"old": list(task.fragments), "new": [f | {"origins": came} for f in new]}


def commit_compaction(table: Table, results: list[dict]) -> Table:
    """One commit for any number of tasks. Indices keep covering the rows that they know: a row's id is what it was."""
    old = {i for r in results for i in r["old"]}

    def change(body: dict) -> None:
        before = sum(f["rows"] for f in body["fragments"] if f["id"] in old)
        body["fragments"] = [f for f in body["fragments"] if f["id"] not in old]
        left = set().union(*map(origins, body["fragments"])) if body["fragments"] else set()
        for r in results:
            place(body, r["new"], 0, 0, keep=True)
        body["deleted_rows"] -= before - sum(f["rows"] for r in results for f in r["new"])
        # a deletion file goes with the last fragment that it could apply to
        body["deletions"] = [d for d in body["deletions"] if left & set(d["fragments"])]

    return table._commit("rewrite", change)


def compact(table: Table, target_rows: int = MAX_ROWS, max_deleted: float = 0.1) -> dict[str, int]:
    """Plans, runs and commits; the numbers of fragments removed and added. Only fragments of a task are rewritten."""
    results = [run_compaction(table, t, target_rows) for t in plan_compaction(table, target_rows, max_deleted)]
    if results:
        commit_compaction(table, results)
    return {"removed": sum(len(r["old"]) for r in results), "added": sum(len(r["new"]) for r in results)}


def cleanup(table: Table, older_than: float | None = None, keep: int | None = None, ignore_tagged: bool = False, unverified_after: float = 7 * 86400) -> dict[str, int]:
    """Removes old versions of this branch (by age in seconds or number kept) and files that no version of any branch, or of a clone, refers to any more.

    Tagged versions are an error, or stay with `ignore_tagged`. A file without a version is only removed once it is `unverified_after` seconds old: it may belong to a commit under way."""
    names = table.store.list(table._folder(table.branch))
    bodies = [(n, table.store.read(f"{table._folder(table.branch)}/{n}")) for n in names]
    now = time.time()
    tagged = {t["version"] for t in table.tags().values() if t["branch"] == table.branch}
    old = []
    for i, (n, b) in enumerate(bodies[:-1]):
        if (older_than is not None and now - b["timestamp"] > older_than) or (keep is not None and i < len(bodies) - keep):
            if b["version"] in tagged:
                if ignore_tagged:
                    continue
                raise TableError(f"version {b['version']} is tagged")
            old.append((n, b))
    dropped = {x for x, _ in old}
    live = [b for n, b in bodies if n not in dropped]
    for branch in table.branches():
        if branch != table.branch:
            live += [table.store.read(f"{table._folder(branch)}/{n}") for n in table.store.list(table._folder(branch))]
    for name in table.store.list("_clones"):
        other = Store(table.spark, table.store.read(f"_clones/{name}")["uri"])
        for folder in ["_versions", *(f"_branches/{b}" for b in other.list("_branches"))]:
            live += [other.read(f"{folder}/{n}") for n in other.list(folder)]

    def files(b: dict) -> set[str]:
        return {f for x in b["fragments"] for f in x["files"]} | {d["path"] for d in b["deletions"]} | {p for x in b["indices"] for p in x["paths"]}

    used = set().union(*map(files, live))
    dead = set().union(*(files(b) for _, b in old)) - used if old else set()
    root = table.uri
    for f in dead:
        if f.startswith(root):
            table.store.delete(f, True)
    for n, _ in old:
        table.store.delete(f"{table._folder(table.branch)}/{n}")
    stray = 0
    for folder in table.store.list("data"):
        path = f"{root}/data/{folder}"
        if not any(f.startswith(path) for f in used) and now - table.store.modified(path) > unverified_after:
            table.store.delete(path, True)
            stray += 1
    return {"versions": len(old), "files": len(dead), "stray": stray}
