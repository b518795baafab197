"""Edits of wanted lists, preferences, numbers and claims, each as a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallowick.functions import titles
from tallowick.operators.order import placed

FIRST_NUMBER = 9000
DURABLE = ("epg_source", "group", "confirmed", "settled_on", "watermark_box", "logo_override")


def added(wanted: DataFrame, keys: DataFrame, pools: DataFrame) -> DataFrame:
    """``wanted`` with rows for the keys (``key, pos``) that it lacks and a pool has: numbered on from the largest, with the name and id of the pool's first stream."""
    first = pools.groupBy(F.col("channel_key").alias("key")).agg(F.min_by(F.struct("name", "tvg_id"), "src_pos").alias("x"))
    new = keys.groupBy("key").agg(F.min("pos").alias("pos")).join(wanted.select("key"), "key", "left_anti").join(first, "key")
    top = wanted.agg(F.coalesce(F.max("number") + 1, F.lit(FIRST_NUMBER)).alias("top"))  # one row
    rows = placed(new, "pos", name="_n").join(top).select("key", (F.col("top") + F.col("_n") - 1).cast("int").alias("number"), F.col("x.name").alias("name"), F.coalesce("x.tvg_id", F.lit("")).alias("tvg_id"))
    return wanted.select("key", "number", "name", "tvg_id").unionByName(rows)


def picked(ids: DataFrame, streams: DataFrame, log: DataFrame) -> DataFrame:
    """Streams of ``ids`` (``channel_key, id``), of equal ids the last, that the channel has no result of; ``would_match`` is the key they have themselves."""
    last = streams.groupBy("id").agg(F.max_by(F.struct("name", F.col("channel_key").alias("own")), "src_pos").alias("x"))
    rows = ids.distinct().join(last, "id").join(log.select("channel_key", F.col("stream_id").alias("id")), ["channel_key", "id"], "left_anti")
    return rows.select("channel_key", "id", "x.name", F.col("x.own").alias("would_match"))


def imported(wanted: DataFrame, remote: DataFrame) -> DataFrame:
    """``wanted`` and remote channels (``key, remote_id, number, name, group``) together: the remote side is recorded, a number or name that is there stays, a group counts only where none is."""
    theirs = remote.filter("key <> ''").groupBy("key").agg(F.max_by(F.struct("remote_id", "number", "name", "group"), "remote_id").alias("x"))
    both = wanted.withColumn("_here", F.lit(True)).join(theirs, "key", "full")
    mine = lambda c: F.when(F.col("_here"), F.col(c)).otherwise(F.col(f"x.{c}"))
    return both.select("key", mine("number").alias("number"), mine("name").alias("name"), F.coalesce(F.nullif("group", F.lit("")), F.nullif("x.group", F.lit(""))).alias("group"), F.col("x.remote_id").alias("remote_id"))


def claimed(wanted: DataFrame, claims: DataFrame) -> DataFrame:
    """``wanted`` with remote channels (``key, number, name``) claimed in place, which fills a number that is missing, or else appended."""
    theirs = claims.filter("key <> ''").groupBy("key").agg(F.min_by(F.struct("number", "name"), "pos").alias("x"))
    both = wanted.withColumn("_here", F.lit(True)).join(theirs, "key", "full")
    return both.select("key", F.coalesce("number", "x.number").alias("number"), F.when(F.col("_here"), F.col("name")).otherwise(F.col("x.name")).alias("name"), (F.col("_here").isNotNull() & F.col("x").isNotNull()).alias("relinked"))


def renamed(rows: DataFrame, renames: DataFrame, column: str = "name") -> DataFrame:
    """``rows`` with the old names (``old, new``) replaced, in whichever table they stand."""
    new = renames.select(F.col("old").alias(column), "new")
    return rows.join(new, column, "left").withColumn(column, F.coalesce("new", column)).drop("new")


def known_groups(own: DataFrame, remote: DataFrame) -> DataFrame:
    """Groups chosen for channels, and remote ones that have channels, in order without regard to case."""
    rows = own.select("group").union(remote.filter("channel_count > 0").select("name")).filter(~titles.is_blank(F.col("group"))).distinct()
    return rows.orderBy(F.lower("group"), "group")


def without_groups(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` whose group is taken away have none."""
    marked = rows.join(gone.select("group", F.lit(True).alias("_gone")).distinct(), "group", "left")
    return marked.withColumn("group", F.when(F.col("_gone").isNull(), F.col("group"))).drop("_gone")


def preferences(old: DataFrame, new: DataFrame) -> DataFrame:
    """``key, field, value``: later values over earlier ones, field by field; a null value takes the field away."""
    later = new.groupBy("key", "field").agg(F.max_by(F.struct(F.col("value").alias("new")), "pos").alias("x"))
    both = old.join(later, ["key", "field"], "full")
    return both.select("key", "field", F.when(F.col("x").isNotNull(), F.col("x.new")).otherwise(F.col("value")).alias("value")).filter("value is not null")


def durable(prefs: DataFrame) -> DataFrame:
    """What of a run's choices its line-up keeps: some fields, and of these only values that say something."""
    return prefs.filter(F.col("field").isin(*DURABLE) & ~F.coalesce(F.col("value"), F.lit("")).isin("", "false", "0"))


def seeded(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``key, group``: a list's headers for channels that have no group of their own yet."""
    some = lambda df: df.filter(~titles.is_blank(F.col("group"))).select("key", "group")
    return some(existing).unionByName(some(wanted).join(some(existing).select("key"), "key", "left_anti"))


def overrides(old: DataFrame, new: DataFrame, ranked: DataFrame) -> DataFrame:
    """``channel_key, algorithm_pick, curator_pick`` where a new primary differs from the old one and from the best candidate, and is a candidate."""
    first = ranked.filter("rank = 1").select("channel_key", F.col("stream_id").alias("algorithm_pick"))
    fresh = new.filter("primary is not null").join(old.select("channel_key", F.col("primary").alias("before")), "channel_key", "left").filter(~F.col("primary").eqNullSafe(F.col("before")))
    real = fresh.join(ranked.select("channel_key", F.col("stream_id").alias("primary")), ["channel_key", "primary"], "left_semi")
    return real.join(first, "channel_key").filter("primary <> algorithm_pick").select("channel_key", "algorithm_pick", F.col("primary").alias("curator_pick"))


def source_order(sources: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """``sources`` with ``priority`` dealt anew from 0: those named (``name, pos``) first, then by the old priority, those without last, then by name."""
    rows = sources.withColumn("_at", F.lit(None).cast("long")) if named is None else sources.join(named.select("name", F.col("pos").cast("long").alias("_at")), "name", "left")
    rows = rows.select("*", F.struct(F.col("_at").isNull().alias("a"), F.col("_at").alias("b"), F.col("priority").isNull().alias("c"), F.col("priority").alias("d"), F.col("name").alias("e")).alias("_order"))
    return placed(rows, "_order", name="_n").withColumn("priority", (F.col("_n") - 1).cast("int")).drop("_n", "_at", "_order")


def claims_by_key(claims: DataFrame) -> DataFrame:
    """The last claim of each key."""
    return claims.groupBy("key").agg(F.max_by(F.struct("remote_id", "name", "source"), "pos").alias("x")).select("key", "x.*")


def released(claims: DataFrame, source: str) -> DataFrame:
    """The claims that another source made."""
    return claims.filter(~F.coalesce(F.col("source") == source, F.lit(False)))


def removals(staged: DataFrame, remote: DataFrame) -> DataFrame:
    """``staged`` with what taking its numbers away does: deleted where the remote system has them, else already gone."""
    there = remote.select(F.col("channel_number").cast("double").alias("number"), F.lit(True).alias("_there")).distinct()
    return staged.withColumn("number", F.col("number").cast("double")).join(there, "number", "left").withColumn("outcome", F.when(F.col("_there"), "deleted").otherwise("already gone")).withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")


def ratcheted(current: Column, found: Column) -> Column:
    """A limit that only becomes tighter; 0 is none."""
    return F.when(found.isNull() | ((current > 0) & (current <= found)), current).otherwise(found)


def account_of(sources: DataFrame, accounts: DataFrame) -> DataFrame:
    """The account with exactly the source's address; a blank address has none."""
    real = sources.filter(~titles.is_blank(F.col("url")))
    return real.join(accounts.select("url", F.col("id").alias("account")), "url").select("source", "account")


def renumbered(wanted: DataFrame, order: DataFrame, names: DataFrame) -> DataFrame:
    """``wanted`` with the numbers of the keys in ``order`` (``scope, key, pos``) dealt out anew in that order within each scope.

    A key that the list lacks is added with the name it has in ``names``, numbered on from the
    scope's largest number, or from the list's largest where the scope has none; numbers that
    are taken are skipped.
    """
    have = order.join(wanted.select("key", "number"), "key", "left")
    taken = wanted.filter("number is not null").select("number").distinct()
    top = taken.agg(F.coalesce(F.max("number"), F.lit(FIRST_NUMBER - 1)).alias("top"))  # one row
    lacking = have.join(wanted.select("key"), "key", "left_anti").join(names, "key").withColumn("_i", F.row_number().over(Window.partitionBy("scope").orderBy("pos")))
    need = lacking.groupBy("scope").agg(F.max("_i").alias("need"))
    base = have.groupBy("scope").agg(F.max("number").alias("base")).join(need, "scope").join(top).withColumn("base", F.coalesce("base", "top"))
    # Free numbers after the base: as many as are needed lie within need + taken numbers behind it.
    behind = base.join(taken, F.col("number") > F.col("base")).groupBy("scope").agg(F.count("*").alias("busy"))
    free = base.join(behind, "scope", "left").select("scope", F.explode(F.sequence(F.col("base") + 1, F.col("base") + F.col("need") + F.coalesce("busy", F.lit(0)))).alias("number")).withColumn("number", F.col("number").cast("int")).join(taken, "number", "left_anti")
    numbered = free.withColumn("_i", F.row_number().over(Window.partitionBy("scope").orderBy("number")))
    new = lacking.drop("number").join(numbered, ["scope", "_i"]).select("scope", "key", "pos", "number", "name")
    rows = have.filter("number is not null").select("scope", "key", "pos", "number").unionByName(new.drop("name"))
    dealt = rows.withColumn("_n", F.row_number().over(Window.partitionBy("scope").orderBy("pos"))).join(rows.select("scope", F.col("number").alias("dealt"), F.row_number().over(Window.partitionBy("scope").orderBy("number")).alias("_n")), ["scope", "_n"]).select("key", "dealt")
    whole = wanted.select("key", "number", "name").unionByName(new.select("key", "number", "name"))
    return whole.join(dealt, "key", "left").select("key", F.coalesce("dealt", "number").alias("number"), "name")


def swapped(wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """``wanted`` with the numbers of two keys (``key_a, key_b``) exchanged, where both are there and differ."""
    known = wanted.select("key", "number")
    side = lambda c: known.select(F.col("key").alias(f"key_{c}"), F.col("number").alias(f"n_{c}"))
    real = pairs.filter("key_a <> key_b").join(side("a"), "key_a").join(side("b"), "key_b")
    new = real.select(F.explode(F.array(F.struct(F.col("key_a").alias("key"), F.col("n_b").alias("new")), F.struct(F.col("key_b").alias("key"), F.col("n_a").alias("new")))).alias("x")).select("x.key", "x.new", F.lit(True).alias("_swap"))
    return wanted.join(new, "key", "left").withColumn("number", F.when(F.col("_swap"), F.col("new")).otherwise(F.col("number"))).drop("new", "_swap")


def set_numbers(wanted: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, number, clash``: what setting numbers would do; a number that another key has is refused and named."""
    owner = wanted.filter("number is not null").groupBy("number").agg(F.min("key").alias("owner"), F.max("key").alias("other"))
    rows = asked.join(wanted.select("key", F.col("number").alias("before")), "key").join(owner, "number", "left")
    clash = F.when(F.col("owner") != F.col("key"), F.col("owner")).when(F.col("other") != F.col("key"), F.col("other"))
    return rows.select("key", F.when(clash.isNull(), F.col("number")).otherwise(F.col("before")).alias("number"), clash.alias("clash"))
