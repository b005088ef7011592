"""A directory catalog: namespaces are folders, tables are folders with versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import Store
from ..sources.table import Table, TableError


class Namespace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)

    def _uri(self, name: str) -> str:
        ref = f"_registered/{name}.json"
        return self.store.read(ref)["uri"] if self.store.exists(ref) else f"{self.root}/{name.replace('.', '/')}"

    def create_namespace(self, name: str) -> None:
        if not self.store.create(f"{name.replace('.', '/')}/_namespace.json", {"name": name}):
            raise TableError(f"namespace {name!r} exists")

    def list_namespaces(self, parent: str = "") -> list[str]:
        base = parent.replace(".", "/")
        return [n for n in self.store.list(base) if self.store.exists(f"{base}/{n}/_namespace.json" if base else f"{n}/_namespace.json")]

    def describe_namespace(self, name: str) -> dict:
        return self.store.read(f"{name.replace('.', '/')}/_namespace.json")

    def drop_namespace(self, name: str) -> None:
        if self.list_tables(name):
            raise TableError(f"namespace {name!r} holds tables")
        self.store.delete(name.replace(".", "/"), True)

    def create_table(self, name: str, df: DataFrame) -> Table:
        return Table.write(df, self._uri(name))

    def register_table(self, name: str, uri: str) -> None:
        Table.open(self.spark, uri)
        if not self.store.create(f"_registered/{name}.json", {"uri": uri}):
            raise TableError(f"table {name!r} exists")

    def deregister_table(self, name: str) -> None:
        self.store.delete(f"_registered/{name}.json")

    def table_exists(self, name: str) -> bool:
        return Table.exists(self.spark, self._uri(name))

    def table(self, name: str, version: int | str | None = None) -> Table:
        return Table.open(self.spark, self._uri(name), version)

    def describe_table(self, name: str) -> dict:
        t = self.table(name)
        return {"name": name, "uri": t.uri, "version": t.version, "rows": t.count_rows(), "schema": t.schema.jsonValue()}

    def list_tables(self, namespace: str = "") -> list[str]:
        base = namespace.replace(".", "/")
        here = [n for n in self.store.list(base) if self.store.list(f"{base}/{n}/_versions" if base else f"{n}/_versions")]
        return sorted(here + ([n[:-5] for n in self.store.list("_registered")] if not namespace else []))

    def drop_table(self, name: str) -> None:
        if not self.table_exists(name):
            raise TableError(f"no table {name!r}")
        self.store.delete(self._uri(name), True)

    def insert(self, name: str, df: DataFrame, mode: str = "append") -> Table:
        return Table.write(df, self._uri(name), mode)

    def query(self, name: str, sql: str) -> DataFrame:
        return self.table(name).sql(sql, name.rpartition(".")[2])
