"""From ranked candidates and a curator's choices to what is exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaid(base: DataFrame, own: DataFrame, key: str, fields: list[str], by_field: bool) -> DataFrame:
    """Settings of both tables: the second replaces a whole entry, or with ``by_field`` single values of it."""
    own = own.select(key, F.lit(True).alias("_own"), *(F.col(f).alias(f"own_{f}") for f in fields))
    both = base.join(own, key, "full")
    pick = (lambda f: F.coalesce(f"own_{f}", f)) if by_field else (lambda f: F.when(F.col("_own"), F.col(f"own_{f}")).otherwise(F.col(f)))
    return both.select(key, *(pick(f).alias(f) for f in fields))


def resolved(channels: DataFrame, selection: DataFrame, ranked: DataFrame, depth: int = 4) -> DataFrame:
    """``channel_key, number, streams, dropped``: the streams to export or why there are none.

    Chosen streams come first, else the primary and fallback, else the best ``depth``
    that play.  Excluded channels leave without a word, before any other check.
    """
    usable = ranked.filter(F.col("status").isin("ok", "dirty")).groupBy("channel_key").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "stream_id"))), lambda x: x["stream_id"]), 1, depth).alias("best"))
    any_rows = ranked.groupBy("channel_key").agg(F.count("*").alias("n"))
    rows = channels.join(selection, "channel_key", "left").join(usable, "channel_key", "left").join(any_rows, "channel_key", "left").filter(F.coalesce("include", F.lit(True)))
    some = lambda c: F.when(F.size(c) > 0, c)
    streams = F.coalesce(some(F.col("streams")), some(F.array_compact(F.array("primary", "fallback"))), F.col("best"))
    reason = F.when(F.coalesce("n", F.lit(0)) == 0, "no candidates").when(F.coalesce(F.size(streams), F.lit(0)) <= 0, "none playable").when(F.col("number").isNull(), "no number")
    return rows.select("channel_key", "number", streams.alias("streams"), reason.alias("dropped"))


def state(n: Column, n_clean: Column, include: Column, confirmed: Column, settled: Column, evidence: Column) -> Column:
    """bad, off, done or review of a channel."""
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "bad").when(~F.coalesce(include, F.lit(True)), "off")
        .when(F.coalesce(confirmed, F.lit(False)) & (settled.isNull() | (settled == evidence)), "done")
        .when(F.coalesce(n_clean, F.lit(0)) == 0, "bad").otherwise("review")
    )


def evidence(ranked: DataFrame) -> DataFrame:
    """``id:status`` of all candidates of a channel in order."""
    return ranked.groupBy("channel_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "stream_id", "status"))), lambda x: F.concat_ws(":", x["stream_id"], x["status"])), "|").alias("evidence"))


def override_analysis(decisions: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Per dimension how often the curator's pick was better, worse or the same as the algorithm's.

    ``decisions`` has ``algorithm_<dimension>`` and ``curator_<dimension>``; null counts as 0.
    """
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(f"curator_{d}").cast("double"), F.lit(0.0)).alias("c"), F.coalesce(F.col(f"algorithm_{d}").cast("double"), F.lit(0.0)).alias("a")) for d in dimensions))
    return decisions.select(F.explode(pairs).alias("x")).groupBy(F.col("x.dimension").alias("dimension")).agg(F.count_if(F.expr("x.c > x.a")).alias("better"), F.count_if(F.expr("x.c < x.a")).alias("worse"), F.count_if(F.expr("x.c = x.a")).alias("same"))


def avoided(decisions: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """``dimension, better``: how often the curator left a candidate with a flag for one without; flags never left are not listed."""
    pairs = F.array(*(F.struct(F.lit(f).alias("dimension"), F.coalesce(F.col(f"algorithm_{f}"), F.lit(False)).alias("a"), F.coalesce(F.col(f"curator_{f}"), F.lit(False)).alias("c")) for f in flags))
    return decisions.select(F.explode(pairs).alias("x")).groupBy(F.col("x.dimension").alias("dimension")).agg(F.count_if(F.expr("x.a and not x.c")).alias("better")).filter("better > 0")


def recent(decisions: DataFrame, n: int = 25, pos: str = "pos") -> DataFrame:
    """The last decisions, the newest first."""
    return decisions.orderBy(F.desc(pos)).limit(n)
