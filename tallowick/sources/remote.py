"""Streams and channels of panels and remote systems, from the pages of their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIA = " (via proxy)"
COLUMNS = ("id", "name", "url", "group", "logo", "tvg_id", "source")


def read_pages(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Rows of saved answers, each an object with ``results`` or a bare list; a file is a page and a task's work."""
    rows = spark.read.option("wholetext", True).text(path)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{fields}>>")).otherwise(F.from_json("value", f"results array<struct<{fields}>>")["results"])
    return rows.select(F.explode(listed).alias("x")).select("x.*")


def panel_streams(categories: DataFrame, streams: DataFrame, base: str, user: str, password: str) -> DataFrame:
    """A panel's live streams with the names of their categories, whose ids are compared as text."""
    named = categories.select(F.col("category_id").cast("string").alias("_c"), F.col("category_name").alias("group"))
    rows = streams.withColumn("_c", F.col("category_id").cast("string")).join(named, "_c", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    url = F.concat(F.lit(f"{base}/{user}/{password}/"), F.col("stream_id"), F.lit(".ts"))
    return rows.select(F.concat(F.lit("xtream:"), "stream_id").alias("id"), text("name").alias("name"), url.alias("url"), text("group").alias("group"), text("stream_icon").alias("logo"), text("epg_channel_id").alias("tvg_id"), F.lit("xtream").alias("source"))


def active_streams(streams: DataFrame, accounts: DataFrame) -> DataFrame:
    """Streams of no account, or of one that isn't switched off; an unknown account counts as on."""
    off = accounts.filter("not is_active").select(F.col("id").alias("m3u_account"))
    return streams.join(off, "m3u_account", "left_anti")


def lineup(channels: DataFrame, groups: DataFrame) -> DataFrame:
    """Channels with their group's name, empty where it is unknown."""
    named = groups.select(F.col("id").alias("channel_group_id"), F.coalesce("name", F.lit("")).alias("group"))
    return channels.join(named, "channel_group_id", "left").withColumn("group", F.coalesce("group", F.lit("")))


def proxy_streams(channels: DataFrame, base: str) -> DataFrame:
    """A candidate for each channel that has a uuid and a stream, which the remote system plays itself."""
    rows = channels.filter((F.size("streams") > 0) & (F.coalesce("uuid", F.lit("")) != ""))
    none = F.lit("")
    return rows.select(F.concat(F.lit("proxy:"), "uuid").alias("id"), F.concat(F.coalesce(F.nullif("name", none), "uuid"), F.lit(VIA)).alias("name"), F.concat(F.lit(f"{base}/proxy/ts/stream/"), "uuid").alias("url"), none.alias("group"), F.coalesce("logo_url", none).alias("logo"), F.coalesce("tvg_id", none).alias("tvg_id"), F.lit("proxy").alias("source"))


def union(streams: DataFrame, proxies: DataFrame | None = None) -> DataFrame:
    """All candidates with ``src_part``, so that proxies stand behind the streams they repeat."""
    own = streams.select(*COLUMNS, F.lit(0).alias("src_part"))
    return own if proxies is None else own.unionByName(proxies.select(*COLUMNS, F.lit(1).alias("src_part")))
