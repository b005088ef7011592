"""Where a table's small files live: manifests, refs and transactions, through the file system of their path."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


#: Schemes besides local files whose rename fails if the target exists, and is one step.
_ATOMIC = ("hdfs", "viewfs", "abfs", "abfss")


class Store:
    """Small text files below a root, on any Hadoop file system. `create` fails if the file exists."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def at(self, name: str) -> str:
        return name if "://" in name or name.startswith(("/", "file:")) else f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        self._put(self.at(name), value)

    def _put(self, path: str, value: dict) -> None:
        stream = self._fs.create(self._path(path), True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> bool:
        """Writes the file whole under its name, unless it exists; false if it does. A rename decides the race."""
        target = self.at(name)
        if self.exists(name):
            return False
        draft = f"{self.root}/_drafts/{uuid.uuid4().hex}"
        self._put(draft, value)
        where = self._path(target)
        self._fs.mkdirs(where.getParent())
        if where.toUri().getScheme() in (None, "file"):
            files, paths = self._jvm.java.nio.file.Files, self._jvm.java.nio.file.Paths
            try:
                array = self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)
                # a hard link is created or not, atomically
                files.createLink(paths.get(where.toUri().getPath(), array), paths.get(self._path(draft).toUri().getPath(), array))
                won = True
            except Exception:  # noqa: BLE001 - it exists
                won = False
            self.delete(draft)
            return won
        if where.toUri().getScheme() not in _ATOMIC:
            self.delete(draft)
            raise ValueError(f"{where.toUri().getScheme()} has no atomic rename: two writers could both commit")
        if self.exists(name) or not self._fs.rename(self._path(draft), where):
            self.delete(draft)
            return False
        return True

    def list(self, folder: str) -> list[str]:
        path = self._path(self.at(folder))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path) if not s.getPath().getName().startswith(".")) if self._fs.exists(path) else []

    def delete(self, name: str, recursive: bool = False) -> None:
        self._fs.delete(self._path(self.at(name)), recursive)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(self.at(name))).getLength()

    def modified(self, name: str) -> float:
        return self._fs.getFileStatus(self._path(self.at(name))).getModificationTime() / 1000


def scratch(spark: SparkSession) -> str:
    """A new folder for working tables: below the cluster's shared folder, or a temporary one in a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="loomwright-")
    return f"{shared}/{uuid.uuid4().hex}"
