"""Row mutations: delete, update, merge-insert and column merges, each one plan and one commit."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import expression, predicate
from ..sources.table import CREATED, POINTS, ROWID, SYSTEM, UPDATED, CommitConflict, Table, TableError, place


def _drop_rows(table: Table, ids: DataFrame) -> tuple[dict | None, set[int]]:
    """Writes a deletion file of row ids; its manifest entry and the fragments it touches."""
    path = f"{table.uri}/_deletions/{uuid.uuid4().hex}"
    ids.select(ROWID).write.parquet(path)
    saved = table.spark.read.schema(f"{ROWID} long").parquet(path)
    touched = {r[0]: r[1] for r in saved.groupBy(F.shiftright(ROWID, 32)).count().collect()}  # a row per fragment
    rows = sum(touched.values())
    return ({"path": path, "rows": rows, "fragments": sorted(touched)} if rows else None), set(touched)


def _enter(body: dict, entry: dict) -> None:
    """A deletion file into a manifest."""
    body["deletions"] = [*body["deletions"], entry]
    body["deleted_rows"] += entry["rows"]


def delete(table: Table, where: str | Column) -> int:
    """Deletes the rows for which the predicate is true (not null); the number of rows."""
    rows = table.scan()
    entry, touched = _drop_rows(table, rows.filter(F.coalesce(predicate(where, rows), F.lit(False))))
    if entry is None:
        return 0

    table._commit("delete", lambda body: _enter(body, entry), touched)
    return entry["rows"]


def _replace(table: Table, gone: tuple[dict | None, set[int]], fresh: DataFrame | None, operation: str, config: dict[str, str] | None = None) -> None:
    """One commit that drops the rows of a deletion file and adds fresh ones."""
    entry, touched = gone
    first, planned = table.snapshot.body["next_fragment"], table.version + 1
    fragments = table._write_fragments(fresh, planned, first) if fresh is not None else []

    def change(body: dict) -> None:
        if entry is not None:
            _enter(body, entry)
        place(body, fragments, first, planned)
        body["config"] = body["config"] | (config or {})

    table._commit(operation, change, touched)


def update(table: Table, values: Mapping[str, str | Column], where: str | Column | None = None) -> int:
    """Sets columns to SQL expressions over the old row, where the predicate is true; the rows move to the end."""
    types = {f.name: f.dataType for f in table.schema}
    for name in values:
        if name not in types:
            raise TableError(f"no column {name!r}" + (" (nested columns can't be updated)" if "." in name else ""))
    rows = table.scan()
    if where is not None:
        rows = rows.filter(F.coalesce(predicate(where, rows), F.lit(False)))
    gone = _drop_rows(table, rows)
    if gone[0] is None:
        return 0
    set_to = {k: (expression(v, rows) if isinstance(v, str) else v).cast(types[k]) for k, v in values.items()}
    fresh = rows.select(*(set_to[n].alias(n) if n in set_to else F.col(f"`{n}`") for n in types), CREATED)
    _replace(table, gone, fresh, "update")
    return gone[0]["rows"]


class MergeInsert:
    """`MergeInsert(table, on).when_...().execute(source)`. By default matched rows stay and unmatched source rows are inserted.

    Keys compare with `=`, so a null key matches nothing; a source row is inserted if at least one key is not null. A
    target row whose keys are all null is never deleted. Two source rows for one target row are an error."""

    def __init__(self, table: Table, on: str | Sequence[str]):
        self.table = table
        self.on = [on] if isinstance(on, str) else list(on)
        if not self.on:
            raise TableError("merge-insert needs a key column")
        self._matched, self._matched_if = "nothing", None
        self._insert = True
        self._by_source, self._by_source_if = "keep", None
        self._retries, self._timeout = 10, 30.0

    def when_matched_update_all(self, condition: str | None = None) -> MergeInsert:
        """condition: over `source.x` and `target.x`; null is no."""
        self._matched, self._matched_if = "update", condition
        return self

    def when_matched_do_nothing(self) -> MergeInsert:
        self._matched, self._matched_if = "nothing", None
        return self

    def when_matched_fail(self) -> MergeInsert:
        self._matched, self._matched_if = "fail", None
        return self

    def when_not_matched_insert_all(self) -> MergeInsert:
        self._insert = True
        return self

    def when_not_matched_do_nothing(self) -> MergeInsert:
        self._insert = False
        return self

    def when_not_matched_by_source_delete(self, condition: str | None = None) -> MergeInsert:
        self._by_source, self._by_source_if = "delete", condition
        return self

    def conflict_retries(self, retries: int, timeout: float = 30.0) -> MergeInsert:
        self._retries, self._timeout = retries, timeout
        return self

    def execute(self, source: DataFrame, config: dict[str, str] | None = None) -> dict[str, int]:
        """Commits (with entries of `config`, if any); counts of inserted, updated and deleted rows, and the attempts it took."""
        if self._matched == "nothing" and not self._insert and self._by_source == "keep":
            raise TableError("this merge would do nothing")
        began = time.time()
        for attempt in range(1, self._retries + 2):
            try:
                return self._once(source, config) | {"attempts": attempt}
            except CommitConflict:
                if attempt > self._retries or time.time() - began > self._timeout:
                    raise
                self.table.snapshot = Table.open(self.table.spark, self.table.uri, branch=self.table.branch).snapshot
                time.sleep(min(1.0, 0.05 * 2**attempt))
        raise AssertionError

    def plan(self, source: DataFrame) -> DataFrame:
        """Source and target joined, with `_action`: update, insert, delete, keep or none."""
        names = [f.name for f in self.table.schema]
        extra = set(source.columns) - set(names)
        if extra or not set(self.on) <= set(source.columns):
            raise TableError(f"the source must hold the keys and no columns but the table's: {sorted(extra)}")
        s = source.select(*(F.col(f"`{c}`").alias(f"s_{c}") for c in source.columns)).withColumn("_s", F.lit(True))
        t = self._target(source).select(*(F.col(f"`{c}`").alias(f"t_{c}") for c in names), ROWID, CREATED, UPDATED)
        on = None
        for k in self.on:
            same = F.col(f"s_{k}") == F.col(f"t_{k}")
            on = same if on is None else on & same
        need_rest = self._by_source == "delete"
        how = "full_outer" if need_rest and self._insert else "left_outer" if self._insert else "right_outer" if need_rest else "inner"
        both = s.join(t, on, how)
        has_s, has_t = F.col("_s").isNotNull(), F.col(ROWID).isNotNull()
        some_key = F.greatest(*(F.col(f"s_{k}").isNotNull() for k in self.on)) if len(self.on) > 1 else F.col(f"s_{self.on[0]}").isNotNull()
        some_t_key = F.greatest(*(F.col(f"t_{k}").isNotNull() for k in self.on)) if len(self.on) > 1 else F.col(f"t_{self.on[0]}").isNotNull()
        action = F.when(has_s & has_t, self._on_matched(source.columns, names))
        action = action.when(has_s & some_key, F.lit("insert" if self._insert else "none")).when(has_s, F.lit("none"))
        if self._by_source == "delete":
            gone = some_t_key if self._by_source_if is None else some_t_key & F.coalesce(F.expr(_qualify(self._by_source_if, names, "t_")), F.lit(False))
            action = action.when(gone, F.lit("delete"))
        return both.withColumn("_action", action.otherwise(F.lit("keep")))

    def _target(self, source: DataFrame) -> DataFrame:
        """The table's rows that the merge can touch: where a scalar index knows the key and the source has few keys, only theirs."""
        from . import indices

        known = [x for x in self.table.snapshot.body["indices"] if x["column"] == self.on[0] and x["type"] in ("BTREE", "BITMAP", "BLOOMFILTER") and not x.get("json_path")]
        if self._by_source == "delete" or not known:
            return self.table.scan()
        keys = [r[0] for r in source.select(F.col(f"`{self.on[0]}`")).filter(F.col(f"`{self.on[0]}`").isNotNull()).distinct().limit(POINTS + 1).collect()]
        found = indices._ask(self.table, self.on[0], "in", keys) if keys and len(keys) <= POINTS else None
        return self.table.scan() if found is None else indices.fetch(self.table, *found)

    def _on_matched(self, source: Sequence[str], names: Sequence[str]) -> Column:
        if self._matched == "nothing":
            return F.lit("keep")
        if self._matched == "fail":
            return F.lit("fail")
        if self._matched_if is None:
            return F.lit("update")
        text = self._matched_if
        for c in sorted(names, key=len, reverse=True):
            text = text.replace(f"source.{c}", f"`s_{c}`").replace(f"target.{c}", f"`t_{c}`")
        return F.when(F.coalesce(F.expr(text), F.lit(False)), F.lit("update")).otherwise(F.lit("keep"))

    def _once(self, source: DataFrame, config: dict[str, str] | None) -> dict[str, int]:
        """The joined actions are computed once and written; counts, checks, deletions and new rows read them."""
        table = self.table
        planned = self.plan(source).filter(F.col("_action").isin("update", "insert", "delete", "fail"))
        cols = []
        for f in table.schema:
            n = f.name
            if n in source.columns:
                cols.append(F.col(f"s_{n}").cast(f.dataType).alias(n))
            else:  # a source of fewer columns leaves the others as they are
                cols.append(F.when(F.col("_action") == "update", F.col(f"t_{n}")).cast(f.dataType).alias(n))
        draft = f"{table.uri}/_drafts/{uuid.uuid4().hex}"
        values = planned.select(F.struct(*cols).alias("row"), "_action", ROWID, F.when(F.col("_action") == "update", F.col(CREATED)).alias(CREATED))
        values.write.parquet(draft)
        try:
            acts = table.spark.read.schema(values.schema).parquet(draft)
            per_row = acts.groupBy("_action", ROWID).count() if self._matched == "update" else acts.groupBy("_action").count().withColumn(ROWID, F.lit(None).cast("long"))
            # updates are counted by target row: more than one source row for it is an error
            counts, twice = {}, False
            for r in per_row.groupBy("_action").agg(F.sum("count").alias("n"), F.max(F.when(F.col(ROWID).isNotNull(), F.col("count"))).alias("most")).collect():
                counts[r["_action"]] = r["n"]
                twice |= r["_action"] == "update" and (r["most"] or 0) > 1
            if counts.get("fail"):
                raise TableError(f"{counts['fail']} source rows match the table")
            if twice:
                raise TableError("ambiguous merge: several source rows match one target row")
            new = counts.get("update", 0) + counts.get("insert", 0)
            lose = counts.get("update", 0) + counts.get("delete", 0)
            gone = _drop_rows(table, acts.filter(F.col("_action").isin("update", "delete"))) if lose else (None, set())
            fresh = acts.filter("_action <> 'delete'").select("row.*", CREATED) if new else None
            if counts or config:
                _replace(table, gone, fresh, "update", config)
        finally:
            table.store.delete(draft, True)
        return {"inserted": counts.get("insert", 0), "updated": counts.get("update", 0), "deleted": counts.get("delete", 0)}


def _qualify(text: str, names: Sequence[str], prefix: str) -> str:
    import re

    return re.sub(r"'(?:[^']|'')*'|`?\b(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b`?", lambda m: f"`{prefix}{m[1]}`" if m[1] else m[0], text)


def merge_columns(table: Table, other: DataFrame, left_on: str, right_on: str | None = None) -> Table:
    """Adds the other frame's columns by key: one match of each row is kept, rows without one get nulls."""
    from .evolve import rewrite

    right_on = right_on or left_on
    add = [c for c in other.columns if c != right_on]
    clash = {f.name for f in table.schema} & set(add)
    if clash:
        raise TableError(f"columns {sorted(clash)} exist")
    other = other.dropDuplicates([right_on]).withColumnRenamed(right_on, "_key")
    rows = table.scan()
    joined = rows.join(other, rows[left_on] == other["_key"], "left").select(*rows.columns, *add)
    return rewrite(table, joined, "merge", set(add))


def update_columns(table: Table, other: DataFrame, left_on: str, right_on: str | None = None) -> Table:
    """Overwrites columns of the rows whose key the other frame holds; the rest stays."""
    from .evolve import rewrite

    right_on = right_on or left_on
    change = [c for c in other.columns if c != right_on]
    missing = set(change) - {f.name for f in table.schema}
    if missing:
        raise TableError(f"no columns {sorted(missing)}")
    other = other.dropDuplicates([right_on]).select(F.col(right_on).alias("_key"), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_n_{c}") for c in change))
    rows = table.scan()
    joined = rows.join(other, rows[left_on] == other["_key"], "left")
    cols = [F.when(F.col("_hit"), F.col(f"_n_{f.name}")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in change else F.col(f"`{f.name}`") for f in table.schema]
    hit = F.when(F.col("_hit"), F.lit(table.version + 1)).otherwise(F.col(UPDATED)).cast("long").alias(UPDATED)
    return rewrite(table, joined.select(*cols, ROWID, CREATED, hit), "merge", set(change))


def replace_fragment(table: Table, fragment: int, df: DataFrame) -> Table:
    """Swaps the data of one fragment."""
    first, planned = table.snapshot.body["next_fragment"], table.version + 1
    fragments = table._write_fragments(table._fit(df), planned, first)

    def change(body: dict) -> None:
        if fragment not in {f["id"] for f in body["fragments"]}:
            raise TableError(f"no fragment {fragment}")
        body["fragments"] = [f for f in body["fragments"] if f["id"] != fragment]
        place(body, fragments, first, planned)

    return table._commit("replace", change)


__all__ = ["SYSTEM", "MergeInsert", "delete", "merge_columns", "replace_fragment", "update", "update_columns"]
