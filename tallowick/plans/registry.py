"""The registered queries and their SQL, and what the plans derive catalogues from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of ``(spark, sf_dir)`` under its name, with SQL of the same result."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, n: Column) -> Column:
    """The value at ``n`` modulo their number."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.pmod(n, F.lit(len(values))).cast("int"))


def sql_pick(values: tuple, n: str) -> str:
    """``pick`` in SQL."""
    return "CASE (" + n + f") % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " END"
