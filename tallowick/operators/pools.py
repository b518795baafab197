"""Candidate pools: streams that share a title key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallowick.functions import titles, vocab
from tallowick.functions.titles import Titles


def in_regions(streams: DataFrame, regions: Sequence[str], include_unmarked: bool = True, region: str = "region", group: str = "group") -> DataFrame:
    """Streams of the regions: the title's region decides, else the group's; unmarked ones as told."""
    found = F.coalesce(F.col(region), titles.group_region(F.col(group)))
    wanted = sorted({vocab.REGION_SYNONYMS.get(r, r) for r in regions})
    return streams.filter(F.when(found.isNull(), F.lit(include_unmarked)).otherwise(titles.canonical_region(found).isin(wanted)))


def candidates(streams: DataFrame, reader: Titles, regions: Sequence[str] | None = None, include_unmarked: bool = True, include_timeshift: bool = False) -> DataFrame:
    """``streams`` with ``channel_key`` and ``region``, without those that have no key or are shifted in time."""
    kept = streams if include_timeshift else streams.filter(~titles.is_timeshift(F.col("name")))
    keyed = kept.withColumn("channel_key", reader.key_column("name")).withColumn("region", reader.region_column("name"))
    keyed = keyed if regions is None else in_regions(keyed, regions, include_unmarked)
    return keyed.filter("channel_key <> ''")


def by_declared_quality(pools: DataFrame, n: int = 0, key: str = "channel_key", name: str = "name", pos: str = "src_pos") -> DataFrame:
    """``pools`` with ``declared`` and ``place``, its order in the pool; the first ``n`` of each pool, or all."""
    ranked = pools.withColumn("declared", titles.declared_rank(F.col(name)))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("declared"), pos)))
    return ranked.filter(F.col("place") <= n) if n else ranked


def first_channels(pools: DataFrame, n: int, key: str = "channel_key") -> DataFrame:
    """The pools of the first ``n`` keys in order."""
    return pools.join(pools.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def with_members(pools: DataFrame, least: int, key: str = "channel_key") -> DataFrame:
    return pools.join(pools.groupBy(key).count().filter(F.col("count") >= least).select(key), key, "left_semi")


def summary(pools: DataFrame, key: str = "channel_key", name: str = "name", group: str = "group", pos: str = "src_pos") -> DataFrame:
    """Per key: the shortest name, how many streams, up to six names, and the commonest group, the first seen of equals."""
    groups = pools.filter(~titles.is_blank(F.col(group))).groupBy(key, group).agg(F.count("*").alias("n"), F.min(pos).alias("at"))
    common = groups.groupBy(key).agg(F.max_by(group, F.struct(F.col("n"), -F.col("at"))).alias("modal_group"))
    named = pools.groupBy(key).agg(F.min(F.struct(F.length(name), F.col(name))).alias("x"), F.count("*").alias("n_streams"))
    # Tasks and pools hold the first six names each, however many there are.
    six = pools.select(key, name).filter(F.col(name).isNotNull()).distinct().withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(name))).filter("_place <= 6")
    names = six.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(name)).alias("names"))
    named = named.join(names, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    split = titles.split_group(F.col("modal_group"))
    return named.join(common, key, "left").select(key, F.col(f"x.{name}").alias("display"), "n_streams", "names", "modal_group", split["country"].alias("country"), split["category"].alias("category"))


def region_counts(pools: DataFrame) -> DataFrame:
    return pools.filter("region is not null").groupBy("region").agg(F.count("*").alias("n"))


def worklist(pools: DataFrame, log: DataFrame, key: str = "channel_key") -> DataFrame:
    """Keys without a clean result first, then those probed longest ago."""
    seen = log.groupBy(key).agg(F.bool_or(F.col("status") == "ok").alias("clean"), F.max("probed_at").alias("last_seen"))
    keys = pools.select(key).distinct().join(seen, key, "left")
    return keys.orderBy(F.coalesce("clean", F.lit(False)), F.coalesce("last_seen", F.lit(0.0)), key)


def of_channels(pools: DataFrame, keys: DataFrame, key: str = "channel_key") -> DataFrame:
    """The pools of the keys named."""
    return pools.join(keys.select(key), key, "left_semi")


def region_warning(pools: DataFrame, key: str = "channel_key", regions: int = 4, per_channel: float = 6.0, shown: int = 8) -> DataFrame:
    """One row: how many regions the candidates name, the commonest of them, candidates for each channel, and whether either is too many."""
    each = region_counts(pools)
    top = each.orderBy(F.desc("n"), "region").limit(shown).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "region"))), lambda x: F.concat_ws(" ", x["region"], -x["n"])).alias("spread"))
    size = pools.agg(F.count("*").alias("streams"), F.count_distinct(key).alias("channels"))
    number = each.agg(F.count("*").alias("regions"))
    mean = F.round(F.try_divide(F.col("streams"), F.col("channels")), 1)
    return size.join(number).join(top).select("regions", "spread", mean.alias("per_channel"), (F.col("regions") >= regions).alias("diverse"), F.coalesce(F.col("streams") > per_channel * F.col("channels"), F.lit(False)).alias("many"))  # one row each


def totals(records: DataFrame, key: str = "channel_key") -> DataFrame:
    """One row: channels, candidates, and channels with a clean candidate."""
    each = records.groupBy(key).agg(F.count("*").alias("n"), F.bool_or(F.col("status") == "ok").alias("clean"))
    return each.agg(F.count("*").alias("channels"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.count_if("clean").alias("with_clean"))
