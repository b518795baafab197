"""What an export would change in a remote table, and edits of numbered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallowick.operators.order import placed


def expanded(channels: DataFrame, separate: bool = False) -> DataFrame:
    """One row for each channel; with ``separate`` a second one for the fallback, half a number on and without a guide id."""
    main = F.struct(F.col("number").cast("double").alias("number"), F.col("name").alias("name"), F.col("tvg_id").alias("tvg_id"), F.col("primary").alias("stream"), F.lit(False).alias("fallback"))
    spare = F.struct((F.col("number") + 0.5).cast("double").alias("number"), F.concat(F.lit("FALLBACK: "), "name").alias("name"), F.lit(None).cast("string").alias("tvg_id"), F.col("fallback_stream").alias("stream"), F.lit(True).alias("fallback"))
    rows = F.array_compact(F.array(main, F.when(F.col("fallback_stream").isNotNull(), spare))) if separate else F.array(main)
    return channels.select("key", F.explode(rows).alias("x")).select("key", "x.*")


def difference(wanted: DataFrame, remote: DataFrame, claims: DataFrame, fields: tuple[str, ...] = ("name", "group", "tvg_id")) -> DataFrame:
    """An ``action`` for each wanted row: create, update, unchanged, relink or blocked; and ``changed``, the fields that differ.

    Rows meet by number.  A remote row that no claim covers is only linked again if its
    name, but for case, or one of its streams is the same; a null never changes a field.
    """
    theirs = remote.select(F.col("id").alias("remote_id"), F.col("channel_number").cast("double").alias("number"), *(F.col(f).alias(f"their_{f}") for f in fields), F.col("streams").alias("their_streams"))
    owned = claims.select("remote_id", F.lit(True).alias("claimed")).distinct()
    rows = wanted.withColumn("number", F.col("number").cast("double")).join(theirs, "number", "left").join(owned, "remote_id", "left")
    changed = F.array_compact(F.array(*(F.when(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"their_{f}")), F.lit(f)) for f in fields), F.when(~F.col("streams").eqNullSafe(F.col("their_streams")), F.lit("streams"))))
    same = (F.lower("name") == F.lower("their_name")) | F.arrays_overlap("streams", "their_streams")
    action = F.when(F.col("remote_id").isNull(), "create").when(F.col("claimed").isNull(), F.when(F.coalesce(same, F.lit(False)), "relink").otherwise("blocked")).when(F.size("changed") > 0, "update").otherwise("unchanged")
    return rows.withColumn("changed", changed).withColumn("action", action).select("key", "number", "remote_id", "action", "changed")


def stream_by_url(streams: DataFrame) -> DataFrame:
    """One stream for each url: the provider's own before added ones, then the last."""
    best = F.max(F.struct((~F.coalesce("is_custom", F.lit(False))).alias("native"), "pos", "id")).alias("x")
    return streams.groupBy("url").agg(best).select("url", F.col("x.id").alias("id"), (~F.col("x.native")).alias("is_custom"))


def vacated_groups(before: DataFrame, after: DataFrame) -> DataFrame:
    """Groups that had channels before and have none after."""
    return before.select("group").distinct().join(after.select("group").distinct(), "group", "left_anti")


def dealt_numbers(rows: DataFrame, scope: str, order: str) -> DataFrame:
    """``rows`` in a new order within each scope, the scope's own numbers dealt out ascending."""
    place = F.row_number().over(Window.partitionBy(scope).orderBy(order))
    number = F.row_number().over(Window.partitionBy(scope).orderBy("number", order))
    numbers = rows.select(scope, F.col("number").alias("new_number"), number.alias("_n"))
    return rows.withColumn("_n", place).join(numbers, [scope, "_n"]).drop("_n", "number").withColumnRenamed("new_number", "number")


def contiguous(rows: DataFrame, group: str = "group", line: str = "line_no") -> DataFrame:
    """``rows`` with ``place``: groups in the order of their first line, ungrouped rows last, lines in order."""
    blank = F.col(group).isNull() | (F.col(group) == "")
    first = rows.filter(~blank).groupBy(F.col(group).alias("_group")).agg(F.min(line).alias("_first"))
    grouped = rows.filter(~blank).join(first, F.col(group) == F.col("_group")).select(*rows.columns, F.lit(False).alias("_last"), "_first")
    rest = rows.filter(blank).select(*rows.columns, F.lit(True).alias("_last"), F.lit(None).cast(first.schema["_first"].dataType).alias("_first"))
    return placed(grouped.union(rest), "_last", "_first", line).drop("_last", "_first")
