"""Saved runs and lists, and snapshots of what is fetched, kept for a time."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.sources.files import Store

#: a refresh that takes longer is given up by the others, in seconds
PATIENCE = 600.0


def runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``run`` and the fields of ``<path>/<run>/run.json``; the newest run has the largest name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{path.rstrip('/')}/*/run.json")
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), "*").orderBy(F.desc("run"))


def lists(spark: SparkSession, path: str) -> DataFrame:
    """``name, lines`` of the wanted lists at ``path``: the entries, without comments, headers and empty lines."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("name"), F.trim(F.substring_index("value", "#", 1)).alias("t"))
    return rows.groupBy("name").agg(F.count_if((F.col("t") != "") & ~F.col("t").rlike(r"^\[.*\]$")).alias("lines"))


class Snapshots:
    """Tables by address, each in versions, of which readers take the newest that is whole.

    One reader at a time refreshes an address (the lock is a file that only one can create);
    meanwhile the others read what there is, or wait where there is nothing.  A refresh that
    fails, or whose rows ``good`` rejects, leaves the older version in place.
    """

    def __init__(self, spark: SparkSession, root: str, patience: float = PATIENCE):
        self.spark, self.root, self.patience = spark, root.rstrip("/"), patience
        self.store = Store(spark, self.root)

    def folder(self, address: str) -> str:
        return f"{self.root}/{hashlib.sha256(address.encode()).hexdigest()[:24]}"

    def newest(self, address: str) -> str | None:
        at = self.folder(address)
        whole = [n for n in self.store.names(at) if n.startswith("v-") and self.store.exists(f"{at}/{n}/_SUCCESS")]
        return f"{at}/{whole[-1]}" if whole else None

    def _locked(self, address: str) -> bool:
        lock = f"{self.folder(address)}/lock"
        self.store.fs.mkdirs(self.store.path(self.folder(address)))
        if self.store.create(lock):
            return True
        try:
            given_up = self.store.age(lock, time.time()) > self.patience
        except Exception:  # gone meanwhile
            return self.store.create(lock)
        if given_up:
            self.store.remove(lock)
        return given_up and self.store.create(lock)

    def _refresh(self, address: str, make: Callable[[], DataFrame], good: Callable[[DataFrame], bool] | None) -> None:
        at, old = self.folder(address), self.newest(address)
        made = f"v-{time.time_ns():020d}"
        new, part = f"{at}/{made}", f"{at}/part-{made}"
        try:
            make().write.parquet(part)
            if good is None or good(self.spark.read.parquet(part)):
                self.store.move(part, new)
                for name in self.store.names(at):  # readers may still be at the last one
                    if name.startswith("v-") and f"{at}/{name}" not in (new, old):
                        self.store.remove(f"{at}/{name}")
            elif old is None:
                raise ValueError("the first answer was no good")
        except Exception:
            if old is None:
                raise
        finally:
            if self.store.exists(part):
                self.store.remove(part)
            self.store.remove(f"{at}/lock")

    def read(self, address: str, seconds: float, make: Callable[[], DataFrame], good: Callable[[DataFrame], bool] | None = None, now: float | None = None) -> DataFrame:
        """The table of ``address`` if it is at most ``seconds`` old, else that of ``make()``, if it can be made."""
        until = time.time() + self.patience
        while True:
            found = self.newest(address)
            if found and self.store.age(f"{found}/_SUCCESS", time.time() if now is None else now) <= seconds:
                return self.spark.read.parquet(found)
            if self._locked(address):
                again = self.newest(address)
                if again == found:
                    self._refresh(address, make, good)
                else:
                    self.store.remove(f"{self.folder(address)}/lock")
                return self.spark.read.parquet(self.newest(address))
            if found:
                return self.spark.read.parquet(found)
            if time.time() > until:
                raise TimeoutError(f"nobody has fetched what {self.folder(address)} is for")
            time.sleep(0.1)


def kept_for(spark: SparkSession, path: str, seconds: float, make: Callable[[], DataFrame], now: float | None = None) -> DataFrame:
    """The table kept at ``path`` if it was written within ``seconds``, else ``make()``, which replaces it for those who read from now on."""
    return Snapshots(spark, path).read("", seconds, make, now=now)
