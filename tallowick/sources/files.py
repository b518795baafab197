"""Files with a name of their own, on any file system that Spark reaches, from tables that many tasks write."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tallowick.storage import new_path


class Store:
    """The file system of a path, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, path: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        """The names in a folder, in order; none if there is no such folder."""
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def age(self, path: str, now: float) -> float:
        return now - self.fs.getFileStatus(self.path(path)).getModificationTime() / 1000

    def create(self, path: str) -> bool:
        """An empty file, unless it is there: of several that try at once one succeeds."""
        uri = self.fs.makeQualified(self.path(path)).toUri()
        if uri.getScheme() == "file":  # where Hadoop looks first and creates then
            try:
                os.close(os.open(uri.getPath(), os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        try:
            return bool(self.fs.createNewFile(self.path(path)))
        except Exception as e:
            if self.exists(path):
                return False
            raise OSError(f"can't create {path}") from e

    def move(self, a: str, b: str) -> None:
        self.fs.mkdirs(self.path(b).getParent())
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"could not move {a} to {b}")

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def one_file(rows: DataFrame, path: str, compression: str | None = None) -> str:
    """Write the texts of the only column of ``rows``, in their order, as the lines of one file.

    An ordered table is dealt out by ranges: its tasks write their ranges side by side, and the
    parts are joined end to end at the end, as a stream (parts that are packed by gzip are members
    of one gzip file).  The file appears whole or not at all, and replaces an older one.
    """
    spark = rows.sparkSession
    parts, joined = new_path(spark, "parts"), f"{path}.joining"
    writer = rows.write if compression is None else rows.write.option("compression", compression)
    store = Store(spark, path)
    try:
        writer.text(parts)
        written = Store(spark, parts)
        out = store.fs.create(store.path(joined), True)
        try:
            for name in written.names(parts):
                if name.startswith("part-"):
                    part = written.fs.open(written.path(f"{parts}/{name}"))
                    try:
                        store.jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, store.conf, False)
                    finally:
                        part.close()
        finally:
            out.close()
        store.remove(path)
        store.move(joined, path)
    finally:
        Store(spark, parts).remove(parts)
    return path


def named_files(rows: DataFrame, path: str, pattern: str) -> str:
    """Write ``name, value``: a file for each name, which takes the place of ``@`` in ``pattern``; a name's lines keep their order within a task.

    Tasks write the files; here they are only renamed.
    """
    spark = rows.sparkSession
    parts = new_path(spark, "named")
    rows.repartition("name").sortWithinPartitions("name", *(c for c in rows.columns if c not in ("name", "value"))).select("name", "value").write.partitionBy("name").text(parts)
    store = Store(spark, parts)
    for folder in store.names(parts):
        if folder.startswith("name="):
            (own,) = (n for n in store.names(f"{parts}/{folder}") if n.startswith("part-"))
            store.move(f"{parts}/{folder}/{own}", f"{path}/{pattern.replace('@', folder.removeprefix('name='))}")
    store.remove(parts)
    return path
