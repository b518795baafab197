"""What came before a row in its key's order, without bringing a key's rows to one task.

Rows are dealt out by ranges of key and order.  A key's rows are one range's or several
neighbouring ranges', however many they are; each such slice is worked off by itself and
hands on one value to the slices after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallowick.storage import keep


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], **wanted: tuple[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``wanted``, over the rows of the key that come before.

    ``wanted`` names ``("last", column)``, the last value that isn't null, or ``("max", column)``.
    Rows that are equal in key and order have no order among themselves.
    """
    over = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max}
    values = {f"_value_{name}": column for name, (_, column) in wanted.items()}
    dealt = keep(rows.withColumns(values).repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    place = F.struct(*order)
    whole = {"last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)), "max": F.max}
    each = dealt.groupBy("_slice", *keys).agg(*(whole[kind](f"_value_{name}").alias(f"_handed_{name}") for name, (kind, _) in wanted.items()))
    # A row for each slice; of these only the ones that another slice of the key precedes are left.
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = each.select(F.col("_slice").alias("_to"), *(F.col(k).alias(f"_key_{k}") for k in keys), *(over[kind](f"_handed_{name}").over(before).alias(f"_handed_{name}") for name, (kind, _) in wanted.items()))
    handed = handed.filter(" or ".join(f"_handed_{name} is not null" for name in wanted))
    inside = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.select("*", *(over[kind](f"_value_{name}").over(inside).alias(f"_own_{name}") for name, (kind, _) in wanted.items()))
    same = F.col("_slice") == F.col("_to")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    both = {"last": F.coalesce, "max": F.greatest}
    found = (both[kind](f"_own_{name}", f"_handed_{name}").alias(name) for name, (kind, _) in wanted.items())
    return own.join(handed, same, "left").select(*(F.col(c) for c in rows.columns), *found)


def latest(asks: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, found: str, ties: Sequence[str] = ()) -> DataFrame:
    """``asks`` with ``found``, a struct of the columns of the last of ``facts`` of the same key at that time or before, null if none.

    Both have ``keys`` and ``at``.  Of facts of one time the last by ``ties`` counts.
    """
    time = F.col(at).alias("_at")
    said = facts.filter(F.col(at).isNotNull()).select(*keys, time, F.lit(0).alias("_kind"), *(F.col(t).alias(f"_tie_{t}") for t in ties), F.struct("*").alias("_fact"))
    asked = asks.select(*keys, time, F.lit(1).alias("_kind"), F.struct("*").alias("_ask"))
    both = said.unionByName(asked, allowMissingColumns=True)
    done = running(both, keys, ["_at", "_kind", *(f"_tie_{t}" for t in ties)], _found=("last", F.col("_fact")))
    return done.filter("_kind = 1").select("_ask.*", F.col("_found").alias(found))
