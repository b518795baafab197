"""Searches by a piece of text: over pools, raw names, guides and lists."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_TEXT, SHOWN = 2, 60


def has(c: str, text: str) -> Column:
    return F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))


def in_pools(pools: DataFrame, probed: DataFrame, text: str, limit: int = SHOWN) -> DataFrame:
    """``key, candidates, example, groups, in_run, total`` of pools with the text in their key or in a name.

    Those not probed yet come first, then those of most candidates.
    """
    text = text.strip()
    if len(text) < LEAST_TEXT:
        raise ValueError(f"type at least {LEAST_TEXT} characters")
    each = pools.groupBy("channel_key").agg(F.bool_or(has("name", text)).alias("named"), F.count("*").alias("candidates"), F.min_by("name", "src_pos").alias("example"), F.slice(F.array_sort(F.collect_set(F.coalesce("group", F.lit("")))), 1, 3).alias("groups"))
    done = probed.select("channel_key", F.lit(True).alias("in_run")).distinct()
    hits = each.filter(F.col("named") | has("channel_key", text)).join(done, "channel_key", "left").withColumn("in_run", F.coalesce("in_run", F.lit(False)))
    total = hits.agg(F.count("*").alias("total"))
    best = hits.orderBy("in_run", F.desc("candidates"), "channel_key").limit(limit)
    return best.join(total).select(F.col("channel_key").alias("key"), "candidates", "example", "groups", "in_run", "total")


def modal_region(records: DataFrame, pos: str = "src_pos") -> DataFrame:
    """One row: the commonest region of the records, the first seen of equals."""
    each = records.filter("region is not null").groupBy("region").agg(F.count("*").alias("n"), F.min(pos).alias("at"))
    return each.agg(F.max_by("region", F.struct(F.col("n"), -F.col("at"))).alias("modal"))


def free(streams: DataFrame, pool: DataFrame, records: DataFrame, text: str, limit: int = SHOWN) -> DataFrame:
    """Streams outside the pool with the text in their raw name, once each.

    Those of the records' commonest region come first, then those of none, then by the quality
    they claim and by name.  ``streams`` has ``id, name, region, declared, src_pos``.
    """
    outside = streams.join(pool.select("id"), "id", "left_anti").filter(has("name", text))
    once = outside.groupBy("id").agg(F.min_by(F.struct("name", "region", "declared", "src_pos"), "src_pos").alias("x")).select("id", "x.*")
    near = F.when(F.col("region").isNull(), 1).when(F.col("region") == F.col("modal"), 0).otherwise(2)
    return once.join(modal_region(records)).withColumn("nearness", near).orderBy("nearness", F.desc("declared"), "name", "id").limit(limit).drop("modal")


def across_sources(programmes: DataFrame, text: str, at: Column, tolerance: str = "90 minutes", limit: int = 25) -> DataFrame:
    """Programmes of all sources with the text in their title around a time, ``limit`` of each source, then of all by start."""
    near, end = F.expr(f"interval {tolerance}"), F.coalesce("stop", F.col("start") + F.expr("interval 3 hours"))
    hits = programmes.filter(has("title", text) & (F.col("start") <= at + near) & (end >= at - near))
    order = F.row_number().over(Window.partitionBy("source").orderBy("prog_pos"))
    return hits.withColumn("_n", order).filter(F.col("_n") <= limit).drop("_n").orderBy("start", "source", "prog_pos").limit(limit)


def logos(files: DataFrame, key: str, limit: int = 25) -> DataFrame:
    """File names most like a key, with their ratio of equal letters to three places."""

    def ratio(names: pd.Series) -> pd.Series:
        return names.map(lambda x: round(difflib.SequenceMatcher(None, key, x or "").ratio(), 3)).astype(float)

    return files.withColumn("ratio", F.pandas_udf(ratio, "double")("file_key")).orderBy(F.desc("ratio"), "name").limit(limit)


def needle(name: Column) -> Column:
    """The longest word of three letters and digits or more, the first of equals; null if there is none."""
    words = F.filter(F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    placed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("at"), w.alias("w")))
    return F.array_min(placed)["w"]


def channels_shown(channels: DataFrame, text: str = "", only: str = "all") -> DataFrame:
    """Channels with the text in title or number; ``only`` those ``changed``, to be looked at (``triage``) or ``off``."""
    kinds = {"all": F.lit(True), "changed": F.size("changes") > 0, "triage": F.col("state").isin("bad", "review"), "off": F.col("state") == "off"}
    return channels.filter((has("title", text) | F.coalesce(F.col("number").cast("string").contains(text), F.lit(False))) & kinds[only])


def pools_shown(summary: DataFrame, text: str = "", country: str | None = None, category: str | None = None) -> DataFrame:
    """Rows of a catalogue's summary of a country and category, with the text in the name shown or in one of the names."""
    hit = has("display", text) | F.exists("names", lambda x: F.lower(x).contains(text.lower()))
    for c, wanted in (("country", country), ("category", category)):
        hit = hit & F.coalesce(F.col(c) == wanted, F.lit(False)) if wanted else hit
    return summary.filter(hit)


def sheet_shown(candidates: DataFrame, dupes: bool = False, problems: bool = False, included: bool = False, hide_dead: bool = False) -> DataFrame:
    """Rows of a contact sheet by its switches."""
    hit = F.lit(True)
    for on, rule in ((dupes, F.coalesce("dup", F.lit(False))), (problems, ~F.coalesce(F.col("status") == "ok", F.lit(False))), (included, F.coalesce("include", F.lit(False))), (hide_dead, ~F.coalesce(F.col("status") == "dead", F.lit(False)))):
        hit = hit & rule if on else hit
    return candidates.filter(hit)


def guide_channels_shown(listed: DataFrame, text: str) -> DataFrame:
    """Rows of a guide's channel list with the text in their name or in that of an alternative."""
    return listed.filter(has("guide_name", text) | F.exists("alts", lambda x: F.lower(x["guide_name"]).contains(text.lower())))
