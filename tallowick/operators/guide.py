"""Programme guides: which guide channel a title means, and what it shows at a time.

``channels`` has ``guide_id, name, chan_pos`` (one row for each name), ``programmes``
``guide_id, start, stop, title, prog_pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallowick.functions import titles
from tallowick.operators.slices import latest, running

PREFIX = 6


def retained(programmes: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Programmes that start or stop in the window or span it; those without a start go."""
    inside = lambda c: (F.col(c) >= begin) & (F.col(c) <= end)
    return programmes.filter(F.col("start").isNotNull() & (inside("start") | F.coalesce(inside("stop"), F.lit(False)) | F.coalesce((F.col("start") <= begin) & (F.col("stop") >= end), F.lit(False))))


def name_index(channels: DataFrame) -> DataFrame:
    """``key, guide_id`` for keys that mean one channel: one id, or several of which all names
    differ by words of quality only and exactly one is tagged HD.

    ``channels`` has ``key`` and ``identity`` besides.
    """
    first = channels.filter("key <> ''").groupBy("key", "guide_id").agg(F.min_by(F.struct("name", "identity"), "chan_pos").alias("x"))
    tagged = F.upper("x.name").rlike("(?<![A-Z0-9])HD(?![A-Z0-9])")
    found = first.groupBy("key").agg(F.count("*").alias("ids"), F.count_distinct("x.identity").alias("identities"), F.count_if(tagged).alias("hd"), F.min("guide_id").alias("any_id"), F.max(F.when(tagged, F.col("guide_id"))).alias("hd_id"))
    return found.select("key", F.when(F.col("ids") == 1, F.col("any_id")).when((F.col("identities") == 1) & (F.col("hd") == 1), F.col("hd_id")).alias("guide_id")).filter("guide_id is not null")


def _with_heads(rows: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """``rows`` once for each ``head``, a beginning of ``key`` as long as some key of ``others``, of ``PREFIX`` characters at least."""
    lengths = others.agg(F.collect_set(F.when(F.length("key") >= PREFIX, F.length("key"))).alias("_lengths"))
    fit = F.filter("_lengths", lambda n: n <= F.length(key))
    # One row, with as many lengths as there are among the keys.
    return rows.join(F.broadcast(lengths), how="cross").withColumn("head", F.explode(F.transform(fit, lambda n: F.substring(F.col(key), F.lit(1), n)))).drop("_lengths")


def resolve(wanted: DataFrame, index: DataFrame, known_ids: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``wanted`` (``row, key, tvg_id``) with ``guide_id`` and ``stage``.

    A known ``tvg_id`` comes first, then the key, then the one key that goes on from it
    or from which it goes on, both of at least six characters and alike in timeshift.
    A key begins with another if one of its beginnings equals it, so both ways are joins on
    whole keys, each taken once.  Beginnings as long as no key are not made, and those of the
    index are counted together before they meet a key: a beginning that all keys share is no
    task's burden.  ``by`` names columns of all three tables that must be equal, as a source.
    """
    known = known_ids.select(*by, F.col("guide_id").alias("tvg_id"), F.col("guide_id").alias("known")).distinct()
    step = wanted.join(known, [*by, "tvg_id"], "left")
    taken = index.filter("guide_id is not null").select(*by, "key")
    open_rows = step.filter("known is null").filter(F.length("key") >= PREFIX).select(*by, "row", "key").join(taken, [*by, "key"], "left_anti")
    shift = lambda c: F.col(c).contains("TIMESHIFT")
    asked = open_rows.select(*by, "key", shift("key").alias("shift")).distinct()
    long = index.filter(F.length("key") >= PREFIX).groupBy(*by, F.col("key").alias("other")).agg(F.min("guide_id").alias("near_id")).withColumn("shift", shift("other"))
    met = [*by, "head", "shift"]
    shorter = _with_heads(asked, "key", index).join(long.withColumnRenamed("other", "head"), met).select(*by, "key", F.col("head").alias("a"), F.col("head").alias("b"), "near_id")
    below = _with_heads(long, "other", wanted).groupBy(met).agg(F.min("other").alias("a"), F.max("other").alias("b"), F.min("near_id").alias("near_id"))
    longer = below.join(asked.withColumn("head", F.col("key")), met).select(*by, "key", "a", "b", "near_id")
    # Two keys are enough to know that there is not one.
    few = (F.min("a").alias("a"), F.max("b").alias("b"), F.min("near_id").alias("near_id"))
    near = shorter.union(longer).groupBy(*by, "key").agg(*few)
    one = open_rows.join(near, [*by, "key"]).groupBy(*by, "row").agg(*few).filter("a = b").select(*by, "row", F.col("near_id").alias("by_prefix"))
    # Keys of the index may repeat; their rows are multiplied last.
    out = step.join(one, [*by, "row"], "left").join(index.select(*by, "key", F.col("guide_id").alias("by_key")), [*by, "key"], "left")
    return out.select(*by, "row", "key", "tvg_id", F.coalesce("known", "by_key", "by_prefix").alias("guide_id"), F.when(F.col("known").isNotNull(), "id").when(F.col("by_key").isNotNull(), "key").when(F.col("by_prefix").isNotNull(), "prefix").alias("stage"))


def in_all_sources(wanted: DataFrame, sources: DataFrame, index: DataFrame, known_ids: DataFrame, own: DataFrame | None = None, blocks: int = 32) -> DataFrame:
    """``source, row, guide_id`` for every source and every wanted row (``row, key, tvg_id``), null where the source lacks it.

    ``own`` (``row, source, guide_id``) holds ids picked by hand, which count where the source knows
    them.  Sources are few; their rows are repeated for each block of wanted rows.
    """
    each = sources.select("source").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    all_rows = wanted.withColumn("_block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).join(each, "_block").drop("_block")
    found = resolve(all_rows, index, known_ids, by=("source",))
    if own is None:
        return found.select("source", "row", "guide_id")
    real = own.join(known_ids.select("source", "guide_id").distinct(), ["source", "guide_id"]).select("source", "row", F.col("guide_id").alias("own_id"))
    return found.join(real, ["source", "row"], "left").select("source", "row", F.coalesce("own_id", "guide_id").alias("guide_id"))


def chosen_guides(answers: DataFrame, sources: DataFrame, picked: DataFrame) -> DataFrame:
    """``row, source, guide_id``: for each row the first source with an answer, the one picked for the row (``row, pick``) before all others.

    ``sources`` has ``source, priority``; those without a priority come last, equals by name.
    """
    rows = answers.filter("guide_id is not null").join(sources, "source").join(picked, "row", "left")
    order = F.struct((~F.coalesce(F.col("source") == F.col("pick"), F.lit(False))).alias("other"), F.col("priority").isNull().alias("none"), "priority", "source")
    return rows.groupBy("row").agg(F.min_by(F.struct("source", "guide_id"), order).alias("x")).select("row", "x.*")


def checked(answers: DataFrame, names: DataFrame, wanted: DataFrame, playing: DataFrame) -> DataFrame:
    """What every source says of a row: ``matched``, the guide's own name, how many words it shares with the row's, what runs now, the icon.

    ``names`` has ``source, guide_id, guide_name, icon``, ``playing`` ``source, guide_id, title``.
    """
    rows = answers.join(names, ["source", "guide_id"], "left").join(playing, ["source", "guide_id"], "left").join(wanted.select("row", "name"), "row")
    matched = F.col("guide_id").isNotNull()
    shown = F.when(matched, F.coalesce("guide_name", "guide_id"))
    return rows.select("row", "source", matched.alias("matched"), shown.alias("guide_name"), F.when(matched, titles.word_overlap(F.col("name"), shown)).otherwise(0).alias("score"), F.col("title").alias("now"), "icon")


def channel_list(names: DataFrame, key: str = "key", family: str = "family") -> DataFrame:
    """``guide_id, guide_name, alts``: one row for each channel of a guide, its regional kinds in ``alts``.

    Of rows of one key the shortest name counts, the first of equals; keys of one family, the key
    of the name without its region, make one row, again of the shortest name.  ``names`` has
    ``guide_id, guide_name, chan_pos, key, family``, a row for each channel's first name.
    """
    size = F.length("guide_name")
    by_key = names.groupBy(key).agg(F.min_by(F.struct("guide_id", "guide_name", family), F.struct(size, "chan_pos")).alias("x"), F.min("chan_pos").alias("at")).select("x.*", "at")
    members = F.array_sort(F.collect_list(F.struct(size.alias("n"), "at", "guide_id", "guide_name")))
    listed = by_key.groupBy(family).agg(members.alias("m"))
    alts = F.transform(F.slice("m", F.lit(2), F.size("m")), lambda x: F.struct(x["guide_id"].alias("guide_id"), x["guide_name"].alias("guide_name")))
    return listed.select(F.get("m", F.lit(0))["guide_id"].alias("guide_id"), F.get("m", F.lit(0))["guide_name"].alias("guide_name"), alts.alias("alts"))


def sizes(channels: DataFrame, programmes: DataFrame) -> DataFrame:
    """One row: channels of a guide, those with programmes, programmes."""
    heads = channels.agg(F.count_distinct("guide_id").alias("channels"))
    body = programmes.agg(F.count_distinct("guide_id").alias("with_programmes"), F.count("*").alias("programmes"))
    return heads.join(body)  # one row each


def shown(programmes: DataFrame) -> DataFrame:
    """``programmes`` with ``begins``: from then on, until its end, a programme is the first in order that runs.

    Those before it must be over, one without an end never is; a programme that is never the first
    is left out.  So the times of a channel's programmes don't overlap.
    """
    rows = programmes.filter("start is not null")
    over = F.coalesce("stop", F.lit("9999-12-31").cast(dict(programmes.dtypes)["stop"]))
    rows = running(rows, ["guide_id"], ["start", "prog_pos", "stop", "title"], _hidden=("max", over))
    return rows.withColumn("begins", F.greatest("start", "_hidden")).filter(F.col("begins") < over).drop("_hidden")


def now_playing(probes: DataFrame, programmes: DataFrame, at: str = "at") -> DataFrame:
    """``probes`` (``probe, guide_id`` and a time) with the first programme in order that runs then, if any.

    A programme without an end runs on, and so hides those after it.  Programmes whose end comes
    after the next one's start make several hits; of these the first is taken.
    """
    facts = shown(programmes).select("guide_id", F.col("begins").alias(at), "start", "stop", "title", "prog_pos")
    rows = latest(probes, facts, ["guide_id"], at, "_shown")
    runs = F.col("_shown.stop").isNull() | (F.col(at) < F.col("_shown.stop"))
    return rows.select(*probes.columns, *(F.when(runs, F.col(f"_shown.{c}")).alias(c) for c in ("start", "stop", "title", "prog_pos")))


def title_search(programmes: DataFrame, text: str, at: Column, tolerance: str = "90 minutes", limit: int = 25) -> DataFrame:
    """Programmes with the text in their title that overlap a time; without an end they last three hours."""
    end = F.coalesce("stop", F.col("start") + F.expr("interval 3 hours"))
    near = F.expr(f"interval {tolerance}")
    hit = F.lower("title").contains(text.lower()) & (F.col("start") <= at + near) & (end >= at - near)
    return programmes.filter(hit).orderBy("prog_pos").limit(limit)


def name_search(channels: DataFrame, text: str, limit: int = 25) -> DataFrame:
    """Channels with the text in a name, each with the first such name, in file order."""
    hit = channels.filter(F.lower("name").contains(text.lower()))
    return hit.groupBy("guide_id").agg(F.min(F.struct("chan_pos", "name")).alias("x")).select("guide_id", "x.name", "x.chan_pos").orderBy("chan_pos").limit(limit)


def consensus(checks: DataFrame, trust: DataFrame) -> DataFrame:
    """Per channel the source of the best score, then trust, then name, and whether two sources agree.

    ``checks``: ``channel, source, score`` of matched sources; ``trust``: ``source, wins, seen``.
    """
    scored = checks.join(trust, "source", "left").withColumn("trust", F.coalesce(F.try_divide(F.col("wins"), F.col("seen")), F.lit(0.0)))
    best = F.min(F.struct(-F.col("score"), -F.col("trust"), "source")).alias("x")
    return scored.groupBy("channel").agg(best, F.count_if(F.col("score") >= 1).alias("agree")).select("channel", F.col("x.source").alias("winner"), (F.col("agree") >= 2).alias("consensus"))


def trust_after(trust: DataFrame, checks: DataFrame, winners: DataFrame) -> DataFrame:
    """Sources seen once more for each channel that two or more matched, and their wins."""
    many = checks.withColumn("n", F.count("*").over(Window.partitionBy("channel"))).filter("n >= 2")
    new = many.join(winners, "channel").groupBy("source").agg(F.count_if(F.col("source") == F.col("winner")).alias("w"), F.count("*").alias("s"))
    both = trust.join(new, "source", "full")
    return both.select("source", (F.coalesce("wins", F.lit(0)) + F.coalesce("w", F.lit(0))).alias("wins"), (F.coalesce("seen", F.lit(0)) + F.coalesce("s", F.lit(0))).alias("seen"))


def mismatches(wanted: DataFrame, remote: DataFrame, showing: DataFrame) -> DataFrame:
    """Channels whose guide id differs from the one the remote system shows, numbers compared as numbers."""
    rows = wanted.join(remote, wanted["number"].cast("double") == remote["channel_number"].cast("double")).join(showing, "uuid")
    differ = ~titles.is_blank(F.col("tvg_id")) & ~titles.is_blank(F.col("shown_id")) & (F.lower("tvg_id") != F.lower("shown_id"))
    return rows.filter(differ).select("number", "tvg_id", "shown_id")
