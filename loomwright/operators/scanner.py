"""The scanner: one table, a projection of SQL expressions, a filter, an order, a slice, and nearest neighbours or full text.

The order of the stages is the meaning: source, filter, sort, slice, projection. An alias of the
projection can't be used in the filter or order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import expression, predicate, rewrite
from ..sources.table import DISTANCE, OFFSET, ROWADDR, ROWID, SCORE, SYSTEM, TableError

if TYPE_CHECKING:
    from ..sources.table import Table


def ordering(keys: Sequence[str | tuple]) -> list[Column]:
    """Sort columns from names or (name, ascending, nulls_first); ascending and nulls last by default."""
    out = []
    for k in keys:
        name, up, first = ((k, True, False) if isinstance(k, str) else (*k, True, False)[:3] if len(k) == 1 else (*k, False)[:3])
        c = F.col(name)
        out.append({(True, True): c.asc_nulls_first, (True, False): c.asc_nulls_last, (False, True): c.desc_nulls_first, (False, False): c.desc_nulls_last}[up, first]())
    return out


class Scanner:
    """Options as keywords; `to_df` gives the plan.

    columns: names, or a mapping of names to SQL expressions; filter: SQL text or Column; order_by: see `ordering`;
    nearest: keywords of `vector.nearest`; full_text: a query of `fts`, with `full_text_columns`; prefilter: the filter
    comes before the search (else after its top k); fragments: ids to read.
    """

    def __init__(self, table: Table, columns: Sequence[str] | Mapping[str, str] | None = None, filter: str | Column | None = None, order_by: Sequence | None = None, limit: int | None = None, offset: int | None = None, nearest: dict | None = None, full_text=None, full_text_columns: Sequence[str] | None = None, prefilter: bool = False, with_row_id: bool = False, with_row_address: bool = False, fragments: Sequence[int] | None = None, include_deleted: bool = False, ordered: bool = False, fast_search: bool = False, use_scalar_index: bool = True):  # noqa: A002
        if (limit is not None and limit < 0) or (offset is not None and offset < 0):
            raise TableError("limit and offset must not be negative")
        if nearest is not None and full_text is not None:
            raise TableError("a scan takes either nearest or full_text")
        if nearest is not None and order_by:
            raise TableError("a nearest scan is ordered by distance")
        if columns is not None and not isinstance(columns, Mapping) and len(set(columns)) != len(columns):
            raise TableError("a column is named twice")
        self.table, self.columns, self.filter, self.order_by = table, columns, filter, order_by
        self.limit, self.offset, self.nearest, self.full_text, self.full_text_columns = limit, offset, nearest, full_text, full_text_columns
        self.prefilter, self.with_row_id, self.with_row_address = prefilter, with_row_id, with_row_address
        self.fragments, self.include_deleted, self.ordered, self.fast_search = fragments, include_deleted, ordered, fast_search
        self.use_scalar_index = use_scalar_index

    def _source(self) -> DataFrame:
        df = self.table.scan(self.fragments, self.include_deleted)
        text = " ".join(str(x) for x in (self.filter, self.columns, self.order_by) if x is not None)
        if OFFSET in text:
            df = self.table.with_offsets(df)
        if self.with_row_address or ROWADDR in text:
            df = self.table.with_addresses(df)
        return df

    def _filtered(self, df: DataFrame) -> DataFrame:
        return df if self.filter is None else df.filter(predicate(self.filter, df))

    def _indexed(self, df: DataFrame) -> DataFrame:
        """The source, narrowed by the scalar indices that the filter meets; the filter itself still has to be applied."""
        from . import indices

        if not isinstance(self.filter, str) or not self.use_scalar_index or self.fragments is not None or self.include_deleted or ROWADDR in df.columns or OFFSET in df.columns:
            return df
        found = indices.candidates(self.table, rewrite(self.filter, df))
        return df if found is None else indices.fetch(self.table, *found)

    def _searched(self) -> DataFrame:
        from . import fts, indices, vector

        df = self._source()
        early = self.prefilter or (self.nearest is None and self.full_text is None)
        if early:
            df = self._filtered(self._indexed(df))
        if self.nearest is not None:
            df = vector.nearest(df, table=self.table, fast_search=self.fast_search, masked=early and self.filter is not None, **self.nearest)
        elif self.full_text is not None:
            columns = self.full_text_columns or [f.name for f in self.table.schema if f.dataType.simpleString() == "string"]
            stored = indices.stored_postings(self.table, columns) if self.fragments is None and not self.include_deleted else {}
            if early and self.filter is not None:  # statistics are those of the rows that the filter leaves
                stored = {c: p.join(df.select(ROWID), ROWID, "left_semi") for c, p in stored.items()}
            df = fts.search(df, self.full_text, columns, limit=self.limit if early or self.filter is None else None, stored=stored)
        return df if early else self._filtered(df)

    def to_df(self) -> DataFrame:
        df = self._searched()
        if self.order_by:
            df = df.orderBy(*ordering(self.order_by))
        elif self.nearest is not None:
            df = df.orderBy(DISTANCE, ROWID)
        elif self.full_text is not None:
            df = df.orderBy(F.col(SCORE).desc(), ROWID)
        elif self.ordered or self.limit is not None or self.offset:
            df = df.orderBy(ROWID)
        if self.offset:
            df = df.offset(self.offset)
        if self.limit is not None:
            df = df.limit(self.limit)
        return df.select(*self._projection(df))

    def _projection(self, df: DataFrame) -> list[Column]:
        extra = [c for c in (DISTANCE, SCORE) if c in df.columns]
        if isinstance(self.columns, Mapping):
            out = [expression(sql, df).alias(name) for name, sql in self.columns.items()]
            names = set(self.columns)
        else:
            chosen = self.columns if self.columns is not None else [c for c in df.columns if c not in (*SYSTEM, OFFSET, ROWADDR, *extra)]
            out = [F.col(c).alias(c) if "." in c and c not in df.columns else F.col(f"`{c}`") if c in df.columns else F.col(c) for c in chosen]
            names = set(chosen)
        out += [F.col(c) for c in extra if c not in names]
        if self.with_row_id and ROWID not in names:
            out.append(F.col(ROWID))
        if self.with_row_address and ROWADDR not in names:
            out.append(F.col(ROWADDR))
        return out

    def count(self) -> int:
        return self._searched().count()

    def explain(self, mode: str = "formatted") -> str:
        df = self.to_df()
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def analyze(self) -> str:
        """Runs the scan; the operators that ran, each with its metrics, and the rows that came out."""
        run = self.to_df()._jdf.queryExecution()
        rows = run.toRdd().count()
        lines: list[str] = []

        def show(node, depth: int) -> None:
            name = node.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                return show(node.executedPlan(), depth)
            if name.endswith("QueryStageExec"):
                return show(node.plan(), depth)
            found, it = [], node.metrics().iterator()
            while it.hasNext():
                pair = it.next()
                if pair._2().value() > 0:
                    found.append(f"{pair._1()}={pair._2().value()}")
            lines.append("  " * depth + node.nodeName() + (f" [{', '.join(sorted(found))}]" if found else ""))
            kids = node.children()
            for i in range(kids.size()):
                show(kids.apply(i), depth + 1)

        show(run.executedPlan(), 0)
        return "\n".join([*lines, f"rows: {rows}"])

    def to_arrow(self):
        return self.to_df().toArrow()
