"""Lists against a remote system: what it has that nobody claims, what it lost, what importing it would take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowick.functions import titles
from tallowick.functions.titles import Titles
from tallowick.operators import pools as pool_ops


def unclaimed(channels: DataFrame, claims: DataFrame, groups: DataFrame) -> DataFrame:
    """Remote channels that no claim covers, by number, those without one last."""
    rows = channels.join(claims.select(F.col("remote_id").alias("id")).distinct(), "id", "left_anti")
    named = groups.select(F.col("id").alias("channel_group_id"), F.col("name").alias("group"))
    out = rows.join(named, "channel_group_id", "left").select("id", F.coalesce("name", F.lit("")).alias("name"), F.col("channel_number").alias("number"), F.coalesce("group", F.lit("")).alias("group"), F.size(F.coalesce("streams", F.array().cast("array<long>"))).alias("n_streams"))
    return out.orderBy(F.asc_nulls_last("number"), "id")


def failed_urls(wanted: DataFrame, failures: DataFrame, urls: DataFrame) -> DataFrame:
    """``key, urls``: for wanted channels the failures of each address, by the remote name that events have."""
    hit = wanted.join(failures, wanted["remote_name"] == failures["channel"]).join(urls, "stream_id").filter(~titles.is_blank(F.col("url")))
    one = hit.groupBy("key", "url").agg(F.max_by("failures", "stream_id").alias("n"))
    return one.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("url", "n")))).alias("urls"))


def read_back(channels: DataFrame, pools: DataFrame, wanted: DataFrame, aliases: DataFrame, reader: Titles) -> DataFrame:
    """Remote channels with their key, how many candidates it has, and whether the run wants it, under this key or the one it is an alias of."""
    keyed = channels.withColumn("key", reader.key_column("name"))
    size = pools.groupBy(F.col("channel_key").alias("key")).agg(F.count("*").alias("candidates"))
    other = wanted.join(aliases, wanted["key"] == aliases["alias"]).select(F.col("means").alias("key"))
    run = wanted.select("key").union(other).distinct().withColumn("in_run", F.lit(True))
    out = keyed.join(size, "key", "left").join(run, "key", "left")
    return out.select("id", "name", "number", "key", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("in_run", F.lit(False)).alias("in_run")).orderBy(F.asc_nulls_last("number"), "id")


def probe_seeds(pools: DataFrame, current: DataFrame, log: DataFrame, n: int) -> DataFrame:
    """``channel_key, stream_id, url, is_current``: what importing channels would probe.

    The ``n`` best by the quality they claim, and the remote system's own stream (``channel_key,
    stream_id, url``) unless one of these or a probe has its address; less what the log has.
    """
    best = pool_ops.by_declared_quality(pools, n).select("channel_key", F.col("id").cast("string").alias("stream_id"), "url", F.lit(False).alias("is_current"))
    own = current.filter(~titles.is_blank(F.col("url"))).join(best.select("channel_key", "url"), ["channel_key", "url"], "left_anti").join(log.select("url").distinct(), "url", "left_anti")
    todo = best.unionByName(own.select("channel_key", F.concat(F.lit("remote:"), "stream_id").alias("stream_id"), "url", F.lit(True).alias("is_current")))
    return todo.join(log.select("channel_key", F.col("stream_id").cast("string").alias("stream_id")), ["channel_key", "stream_id"], "left_anti")


def guide_overrides(chosen: DataFrame, remote_sources: DataFrame, remote_guides: DataFrame) -> DataFrame:
    """``key, guide_data_id`` for channels with a source picked for them (``key, pick, guide_id``), by the remote system's own table of that source."""
    sources = remote_sources.select(F.col("id").alias("source_id"), F.col("name").alias("pick"))
    return chosen.filter("pick is not null and guide_id is not null").join(sources, "pick").join(remote_guides.select("source_id", F.col("tvg_id").alias("guide_id"), F.col("id").alias("guide_data_id")), ["source_id", "guide_id"]).select("key", "guide_data_id")


def failover_counts(failures: DataFrame) -> DataFrame:
    return failures.groupBy("channel").agg(F.sum("failures").alias("failovers"))
