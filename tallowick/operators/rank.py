"""Ranking the candidates of a channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallowick.functions import media, vocab

TOLERANCE = 0.15
LEAST_SAMPLE, HOUSE_SHARE = 20, 0.8


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def status_rank(status: Column) -> Column:
    status, out = F.coalesce(status, F.lit("dead")), F.lit(vocab.OTHER_STATUS)
    for name, rank in vocab.STATUS_RANKS.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def snapped(kbps: Column, incumbent: Column) -> Column:
    """A rate within the tolerance of the incumbent's counts as equal to it."""
    near = (kbps != 0) & (F.coalesce(incumbent, F.lit(0)) != 0) & (F.abs(kbps - incumbent) <= TOLERANCE * incumbent)
    return F.when(near, incumbent).otherwise(kbps)


def terms(columns: list[str]) -> list[Column]:
    """The ascending terms of the order; flags and measures that a table lacks count as 0."""
    have = lambda c: _zero(c) if c in columns else F.lit(0)
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in columns else F.lit(0)
    codec = F.when(F.col("video_codec") == "hevc", 0).otherwise(1) if "video_codec" in columns else F.lit(1)
    incumbent = F.col("incumbent_kbps") if "incumbent_kbps" in columns else F.lit(None).cast("double")
    return [
        status_rank(F.col("status")), flag("demoted"), flag("placeholder"), flag("low_contrast"), flag("off_cadence"), flag("dash_multi_bitrate"),
        -(have("width") * have("height")), -snapped(have("measured_kbps"), incumbent), -have("fps"), codec, -have("audio_channels"),
        F.bround(have("corruption_per_sec").cast("double"), 1), have("corruption_errors"),
    ]


def ranked(records: DataFrame, key: str = "channel_key", tie: tuple[str, ...] = ("src_pos",)) -> DataFrame:
    """``records`` with ``rank`` from 1 within each channel; ``tie`` makes the order total."""
    return records.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*terms(records.columns), *tie)))


def with_demoted(records: DataFrame, watched: DataFrame, stream: str = "stream_id") -> DataFrame:
    """``records`` with ``demoted``: whether the watch list (``demoted_id``) holds the stream against its channel."""
    flag = watched.select(F.col("demoted_id").alias(stream), F.lit(True).alias("demoted")).distinct()
    return records.join(flag, stream, "left").withColumn("demoted", F.coalesce("demoted", F.lit(False)))


def picks(ranked_records: DataFrame, n: int) -> DataFrame:
    """The best ``n`` candidates of each channel that play."""
    usable = ranked_records.filter(F.col("status").isin("ok", "dirty"))
    return usable.withColumn("pick", F.row_number().over(Window.partitionBy("channel_key").orderBy("rank"))).filter(F.col("pick") <= n)


def house_cadence(records: DataFrame, fps: str = "fps") -> DataFrame:
    """One row: ``house``, the cadence at least four fifths of a large enough sample share, else null."""
    kind = media.cadence(F.col(fps))
    counts = records.agg(F.count_if(kind == "pal").alias("pal"), F.count_if(kind == "ntsc").alias("ntsc"))
    total = F.col("pal") + F.col("ntsc")
    share = F.greatest("pal", "ntsc") / total
    return counts.select("pal", "ntsc", F.when((total >= LEAST_SAMPLE) & (share >= HOUSE_SHARE), F.when(F.col("pal") >= F.col("ntsc"), "pal").otherwise("ntsc")).alias("house"))


def off_cadence(records: DataFrame, fps: str = "fps") -> DataFrame:
    """``records`` with ``off_cadence``, null where no cadence prevails."""
    house = F.broadcast(house_cadence(records, fps).select("house"))  # one row
    kind = media.cadence(F.col(fps))
    return records.join(house, how="cross").withColumn("off_cadence", F.when(F.col("house").isNotNull(), F.coalesce((kind != F.col("house")) & (kind != "film"), F.lit(False)))).drop("house")


def explained(ranked_records: DataFrame) -> DataFrame:
    """One line of text for each channel: the best candidate and how many play."""
    line = F.format_string("%s: %dx%d at %s fps, %s kbps", "name", "width", "height", F.col("fps").cast("string"), F.col("measured_kbps").cast("string"))
    return ranked_records.groupBy("channel_key").agg(F.min_by(line, "rank").alias("choice"), F.count_if(F.col("status") == "ok").alias("n_ok"))
