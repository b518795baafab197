"""What a curator sees of a run: candidates in order, missing channels, alerts, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallowick.operators.order import placed

NEVER = 10**6


def sheet(ranked: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``channel_key, candidates, n``: a channel's candidates in order, with the fields named."""
    rows = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    return ranked.groupBy("channel_key").agg(rows.alias("candidates"), F.count("*").alias("n"))


def with_missing(channels: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, title, number, missing``: channels with results, and wanted ones without."""
    own = channels.select("key", "title", "number", F.lit(False).alias("missing"))
    return own.unionByName(wanted.join(own.select("key"), "key", "left_anti").select("key", F.col("name").alias("title"), "number", F.lit(True).alias("missing")))


def in_order(channels: DataFrame, wanted: DataFrame) -> DataFrame:
    """``channels`` with ``place``: in the list's order, others behind by number; by title where there is no list."""
    line = wanted.groupBy("key").agg(F.min("line_no").alias("_line"))
    rows = channels.join(line, "key", "left")
    if wanted.isEmpty():
        return placed(rows.withColumn("_t", F.lower("title")), "_t", "key").drop("_line", "_t")
    return placed(rows.withColumns({"_line": F.coalesce("_line", F.lit(NEVER)), "_n": F.coalesce(F.col("number").cast("double"), F.lit(float(NEVER)))}), "_line", "_n", "key").drop("_line", "_n")


def alerts(ranked: DataFrame, changes: DataFrame, picks: DataFrame) -> DataFrame:
    """``channel_key, changes``: worse results of the two best candidates, then what became of the curator's pick.

    ``changes`` is ``log.changes``; ``picks`` has ``channel_key, primary``.  A pick that is not the
    best candidate is gone, no longer clean beside a clean one, or outranked.
    """
    worse = ranked.filter("rank <= 2").join(changes.filter("negative").select("rec_key", "messages"), "rec_key").groupBy("channel_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "messages"))), lambda x: x["messages"])).alias("worse"))
    best = ranked.filter("rank = 1").select("channel_key", F.col("rec_key").alias("best"), F.substring("name", 1, 28).alias("best_name"), F.col("status").alias("best_status"))
    chosen = ranked.select("channel_key", F.col("rec_key").alias("primary"), F.col("status").alias("pick_status"))
    drift = picks.join(best, "channel_key").filter("primary <> best").join(chosen, ["channel_key", "primary"], "left")
    clean = (F.col("pick_status") != "ok") & (F.col("best_status") == "ok")
    said = F.when(F.col("pick_status").isNull(), "the stream you chose is gone from this run").when(clean, F.concat(F.lit("your pick is now "), "pick_status", F.lit("; "), "best_name", F.lit(" is clean"))).otherwise(F.concat("best_name", F.lit(" now ranks above your pick")))
    both = worse.join(drift.select("channel_key", said.alias("drift")), "channel_key", "full")
    return both.select("channel_key", F.array_compact(F.concat(F.coalesce("worse", F.array().cast("array<string>")), F.array("drift"))).alias("changes"))


def signature(candidates: Column, mismatch: Column | None = None) -> Column:
    """The evidence a decision rests on: ``id:status`` of all candidates, then the two guides that differ."""
    shown = F.array_join(F.transform(candidates, lambda x: F.concat_ws(":", x["stream_id"], x["status"])), "|")
    return F.concat(shown, F.lit("||"), F.lit("") if mismatch is None else F.coalesce(F.concat_ws(">", mismatch["theirs"], mismatch["ours"]), F.lit("")))


def active(changes: Column, dismissed: Column) -> Column:
    """Changes that the curator has not dismissed as they are."""
    none = F.array().cast("array<string>")
    return F.when(changes.isNull() | (F.array_join(changes, "\u241f") == F.coalesce(dismissed, F.lit(""))), none).otherwise(changes)


def needs_review(missing: Column, statuses: Column, dup: Column, mismatch: Column) -> Column:
    return missing | ~F.exists(statuses, lambda s: s == "ok") | F.coalesce(dup, F.lit(False)) | F.coalesce(mismatch, F.lit(False))


def state(missing: Column, statuses: Column, dup: Column, mismatch: Column, include: Column, confirmed: Column, settled: Column, evidence: Column) -> Column:
    """ok, review, bad or off of a channel.

    A confirmed channel stays ok while its evidence is what it was settled on, or new
    evidence gives no reason to look again.
    """
    clean = F.exists(statuses, lambda s: s == "ok")
    review = needs_review(missing, statuses, dup, mismatch)
    agreed = F.coalesce(confirmed, F.lit(False)) & (F.coalesce(settled, F.lit("")) != "")
    moved = (settled != evidence) & review
    return F.when(missing, "bad").when(~F.coalesce(include, F.lit(True)), "off").when(agreed & ~moved, "ok").when(~clean, "bad").when(review, "review").otherwise("ok")


def health(channels: DataFrame) -> DataFrame:
    """One row: how many channels need a look, how many changed, all."""
    return channels.agg(F.count_if(F.col("state").isin("review", "bad")).alias("needs_you"), F.count_if(F.size("changes") > 0).alias("changed"), F.count("*").alias("total"))


def reasons(missing: Column, best_name: Column, best_status: Column, statuses: Column, dup: Column, off_cadence: Column, changes: Column) -> Column:
    """Why a channel wants a look, in order."""
    clean = F.exists(statuses, lambda s: s == "ok")
    no = lambda c: F.coalesce(c, F.lit(False))
    own = F.array_compact(F.array(
        F.when(F.size(statuses) <= 0, "nothing has been probed yet"),
        F.when((F.size(statuses) > 0) & ~clean, F.concat(F.lit("no clean stream: best is "), best_name, F.lit(" ("), best_status, F.lit(")"))),
        F.when(no(dup), "a candidate is a holding card"), F.when(no(off_cadence), "a candidate has another country's frame rate"),
    ))
    return F.when(missing, F.array(F.lit("no stream matched this name"))).otherwise(F.concat(own, changes))


def candidate_order(ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    """``ranked`` with ``place``: chosen streams (``channel_key, streams``) in their order, then the others by rank."""
    at = chosen.select("channel_key", F.posexplode("streams").alias("_at", "stream_id")).groupBy("channel_key", "stream_id").agg(F.min("_at").alias("_at"))
    order = Window.partitionBy("channel_key").orderBy(F.asc_nulls_last("_at"), "rank")
    return ranked.join(at, ["channel_key", "stream_id"], "left").withColumn("place", F.row_number().over(order)).drop("_at")


def aspects(candidates: DataFrame, primary: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """``channel_key, stream_id, off``: whether a candidate's shape differs from its channel's.

    The channel's is that of its first chosen stream, else the commonest, the first seen of equals.
    """
    sized = candidates.filter("width > 0 and height > 0").withColumn("ratio", F.col("width") / F.col("height"))
    shape = F.round("ratio", 2)
    own = sized.join(primary.select("channel_key", F.col("primary").alias("stream_id")), ["channel_key", "stream_id"], "left_semi").groupBy("channel_key").agg(F.min(shape).alias("own"))
    common = sized.groupBy("channel_key", shape.alias("r")).agg(F.count("*").alias("n"), F.min("rank").alias("at")).groupBy("channel_key").agg(F.max_by("r", F.struct(F.col("n"), -F.col("at"))).alias("common"))
    both = sized.join(common, "channel_key").join(own, "channel_key", "left").withColumn("expected", F.coalesce("own", "common"))
    return both.select("channel_key", "stream_id", (F.abs(F.col("ratio") - F.col("expected")) / F.col("expected") > tolerance).alias("off"))


def early_stops(results: DataFrame, target: int = 4) -> DataFrame:
    """``results`` with ``skipped``: in order, those for which the channel had ``target`` clean ones already among those not skipped."""
    before = Window.partitionBy("channel_key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return results.withColumn("skipped", F.coalesce(F.count_if(F.col("status") == "ok").over(before), F.lit(0)) >= target)


def last_completed(lineups: DataFrame, runs: DataFrame) -> DataFrame:
    """``name, runs, last_completed`` for each line-up: the newest run, by name, that has ended."""
    done = runs.groupBy(F.col("lineup").alias("name")).agg(F.count("*").alias("runs"), F.max_by("last_completed", F.when(F.coalesce("last_completed", F.lit(0)) != 0, F.col("run_id"))).alias("last_completed"))
    return lineups.join(done, "name", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))


def diagnosis(records: DataFrame, asked: DataFrame, include_dead: bool = False, sample_seconds: int = 25) -> DataFrame:
    """``channel_key, queued, skipped, eta_seconds`` for the channels asked for: their records, dead ones only when told."""
    dead = F.coalesce(F.col("status") == "dead", F.lit(False)) & F.lit(not include_dead)
    each = records.groupBy("channel_key").agg(F.count_if(~dead).alias("queued"), F.count_if(dead).alias("skipped"))
    out = asked.join(each, "channel_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("channel_key", zero("queued").alias("queued"), zero("skipped").alias("skipped"), (zero("queued") * (sample_seconds + 6)).alias("eta_seconds"))


def due_lineups(lineups: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Line-ups whose schedule says now: the hour, for a week's also the day, and long enough since the last run; once-off ones come first."""
    last = runs.groupBy(F.col("lineup").alias("name")).agg(F.max(F.coalesce("last_completed", "started", F.lit(0.0))).alias("_run"))
    rows = lineups.join(last, "name", "left").withColumn("_last", F.greatest(F.coalesce("last_scheduled", F.lit(0.0)), F.coalesce("_run", F.lit(0.0))))
    stamp = F.timestamp_seconds(now)
    weekday = F.weekday(stamp)
    days = F.coalesce("schedule_days", F.lit(0))
    on_time = (days > 0) & (F.hour(stamp) == F.coalesce("schedule_hour", F.lit(2))) & ((days != 7) | (weekday == F.coalesce("schedule_weekday", F.lit(0)))) & (now - F.col("_last") >= days * 86400 - 7200)
    once = F.coalesce(F.col("once_at") <= now, F.lit(False))
    return rows.filter(on_time | once).select("name", once.alias("once")).orderBy(F.desc("once"), "name")
