"""The append-only log of results: latest versions, changes, and what is carried over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key, with ``first_seq``, where the key first stood."""
    whole = F.struct(*log.columns)
    found = log.groupBy(key).agg(F.max_by(whole, seq).alias("_row"), F.min(seq).alias("first_seq"))
    return found.select("_row.*", "first_seq")


def remaining(work: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Work that has no row in the log yet."""
    return work.join(log.select(key).distinct(), key, "left_anti")


def last_two(log: DataFrame, key: str, seq: str, fields: list[str], at: str = "probed_at") -> DataFrame:
    """For keys with a newer last row: the last values of ``fields`` and, as ``old_…``, those before."""
    order = Window.partitionBy(key).orderBy(seq)
    back = Window.partitionBy(key).orderBy(F.desc(seq))
    rows = log.select(key, seq, at, *fields, *(F.lag(f).over(order).alias(f"old_{f}") for f in (at, *fields)), F.row_number().over(back).alias("_back"))
    return rows.filter(f"_back = 1 and {at} > old_{at}").drop("_back")


def changes(log: DataFrame, key: str = "rec_key", seq: str = "seq") -> DataFrame:
    """What got better or worse between the last two results of a stream: ``messages`` and ``negative``."""
    two = last_two(log, key, seq, ["status", "height", "fps"])
    usable = lambda c: F.col(c).isin("ok", "dirty")
    told = lambda name: F.when(F.coalesce(F.col(name), F.lit(0)) != F.coalesce(F.col(f"old_{name}"), F.lit(0)), F.concat_ws(" ", F.lit(name), F.col(f"old_{name}"), F.lit("->"), F.col(name)))
    state = F.when(F.col("status") != F.col("old_status"), F.concat_ws(" ", F.lit("status"), "old_status", F.lit("->"), "status"))
    worse = (usable("old_status") & ~usable("status")) | (F.coalesce("height", F.lit(0)) < F.coalesce("old_height", F.lit(0))) | (F.coalesce("fps", F.lit(0)) < F.coalesce("old_fps", F.lit(0)))
    return two.withColumn("messages", F.array_compact(F.array(state, told("height"), told("fps")))).filter(F.size("messages") > 0).withColumn("negative", worse)


def carried(work: DataFrame, prior: DataFrame, keys: list[str], cutoff, at: str = "probed_at") -> DataFrame:
    """Results of an earlier run that are recent, not dead, and still wanted."""
    fresh = prior.filter((F.col(at) >= cutoff) & (F.col("status") != "dead"))
    return fresh.join(work.select(*keys).distinct(), keys, "left_semi").withColumn("carried_forward", F.lit(True))


def moved(log: DataFrame, old_key: str, new_key: str) -> DataFrame:
    """The log with one channel's rows filed under another."""
    key = F.when(F.col("channel_key") == old_key, new_key).otherwise(F.col("channel_key"))
    return log.withColumn("channel_key", key).withColumn("rec_key", F.concat_ws("|", "channel_key", "stream_id"))


def removed(log: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """The log without the rows of the channels or streams in ``gone``; so are selections that hang on them."""
    return log.join(gone.select(on).distinct(), on, "left_anti")


def duplicated(log: DataFrame, old_key: str, new_key: str) -> DataFrame:
    """The log with one channel's rows filed under another as well."""
    again = log.filter(F.col("channel_key") == old_key).withColumn("channel_key", F.lit(new_key).cast(log.schema["channel_key"].dataType))
    return log.unionByName(again.withColumn("rec_key", F.concat_ws("|", "channel_key", "stream_id")))
