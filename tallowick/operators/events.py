"""Events of the remote system: whose fault a failure is, and bursts of refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallowick.operators.slices import latest


def failures(events: DataFrame, channel: str = "channel", at: str = "ts", kind: str = "kind", stream: str = "stream_id", since=None) -> DataFrame:
    """How often each stream was the last one started or switched to, more than a second before a failover.

    If that last event has no stream, the failover is nobody's; of events of one time the largest stream counts.  ``since`` limits failovers, not what came before.
    """
    rows = events.select(F.col(channel).alias("channel"), F.col(at).alias("when"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(kind).alias("kind"), F.col(stream).alias("stream"))
    starts = rows.filter(F.col("kind").isin("channel_start", "stream_switch")).select("channel", "at", "stream")
    failed = rows.filter(F.col("kind") == "channel_failover")
    failed = failed if since is None else failed.filter(F.col("when") >= since)
    found = latest(failed.select("channel", (F.col("at") - 1_000_001).alias("at")), starts, ["channel"], "at", "last", ties=["stream"])
    return found.filter("last.stream is not null").groupBy(F.col("channel").alias(channel), F.col("last.stream").alias(stream)).agg(F.count("*").alias("failures"))


def burst_candidates(events: DataFrame, key: str, at: str = "ts", seconds: int = 60, least: int = 3) -> DataFrame:
    """Events at which at least ``least`` of their key fell within the last ``seconds``.

    Keys are few and hot, so each is cut into stretches of time; an event counts in its own
    stretch and stands in the next one only to be counted.
    """
    length = max(10 * seconds, 1) * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    stretch = F.floor(F.col("_at") / length)
    near_end = F.col("_at") >= (stretch + 1) * length - seconds * 1_000_000
    rows = events.withColumn("_at", micros).withColumn("_in", F.explode(F.when(near_end, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))))
    window = Window.partitionBy(key, "_in").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("recent", F.count("*").over(window)).filter((F.col("recent") >= least) & (F.col("_in") == stretch)).drop("_at", "_in")


def to_channels(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Errors and reconnects with the channel and run that last claimed their name in a run."""
    last = claims.groupBy("name").agg(F.max_by(F.struct("key", "source"), "pos").alias("x"))
    rows = events.filter(F.col("event_type").isin("channel_error", "channel_reconnect")).join(last, F.col("channel_name") == F.col("name"))
    return rows.filter(F.col("x.source").startswith("run:")).select("id", "timestamp", F.col("x.key").alias("channel_key"), F.substring("x.source", 5, 1 << 30).alias("run"))


def over_threshold(events: DataFrame, key: str, least: int) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def polled(events: DataFrame, mark: int, kinds: tuple[str, ...] = ("channel_error", "channel_reconnect")) -> DataFrame:
    """One row: ``mark``, the largest id seen, which moves on even if nothing new counts; how many events are new and how many count."""
    new = F.col("id") > mark
    return events.agg(F.greatest(F.lit(mark).cast("long"), F.coalesce(F.max("id"), F.lit(mark))).alias("mark"), F.count_if(new).alias("new"), F.count_if(new & F.col("event_type").isin(*kinds)).alias("counting"))
