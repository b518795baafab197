"""Groups of identical still pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallowick.functions import media
from tallowick.operators.components import connected_components
from tallowick.operators.order import placed
from tallowick.storage import keep

NEAR, ALIKE = 8, 10.0
#: rows under a band's value beyond which other bands must meet as well
CROWD = 1024


def _bands(bits: Column, width: int, number: int) -> Column:
    """An array of ``band, part, flip``: the bands' values and all that differ from one in a single bit, which ``flip`` tells from 1 on."""
    edges = [round(i * width / number) for i in range(number + 1)]
    near = []
    for i, (begin, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        value = F.conv(F.substring(bits, begin + 1, end - begin), 2, -10).cast("long")
        flips = F.array(*(F.lit(x - (1 << 64) if x >> 63 else x) for x in (0, *(1 << j for j in range(end - begin)))))
        near.append(F.transform(flips, lambda x, n: F.struct(F.lit(i).alias("band"), value.bitwiseXOR(x).alias("part"), n.alias("flip"))))  # noqa: B023
    return F.concat(*near)


def candidates(classes: DataFrame, near: int = NEAR) -> DataFrame:
    """``a, b, ha, hb`` for rows (``pos, hash``) of different hashes that meet in a band; in some pairs several do.

    Of hashes that differ in ``near`` bits, cut into bands, one band differs in two bits at
    most if there are more than ``near / 3`` of them; and what differs in two bits has a value
    between, one bit from either.  So every hash stands under its bands' values and those one
    bit away, and near hashes meet under one.  Where more than ``CROWD`` rows stand under a value,
    the other bits are cut into bands in the same way and must meet as well.
    """
    number = near // 3 + 1
    bits = F.concat(*(F.lpad(F.conv(F.substring("hash", i, 8), 16, 2), 32, "0") for i in (1, 9)))
    rows = classes.select("pos", "hash", bits.alias("bits"))
    keyed = rows.select("*", F.explode(_bands(F.col("bits"), 64, number)).alias("x")).select("pos", "hash", "bits", "x.*")
    crowded = keyed.groupBy("band", "part").count().filter(F.col("count") > CROWD).select("band", "part", F.lit(True).alias("crowded"))
    marked = keyed.join(crowded, ["band", "part"], "left")
    edges = [round(i * 64 / number) for i in range(number + 1)]
    one = F.array(F.struct(F.lit(-1).alias("band"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("flip")))
    more = one
    for i, (begin, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if end - begin < 64:
            rest = F.concat(F.substring("bits", 1, begin), F.substring("bits", end + 1, 64 - end))
            more = F.when(F.col("crowded") & (F.col("band") == i), _bands(rest, 64 - (end - begin), number)).otherwise(more)
    both = marked.select("pos", "hash", "band", "part", "flip", F.explode(more).alias("y")).select("pos", "hash", "band", "part", "flip", F.col("y.band").alias("band2"), F.col("y.part").alias("part2"), F.col("y.flip").alias("flip2"))
    keys = ["band", "part", "band2", "part2"]
    a, b = (both.select(F.col("pos").alias(x), F.col("hash").alias(f"h{x}"), *keys, F.col("flip").alias(f"f{x}"), F.col("flip2").alias(f"g{x}")) for x in "ab")
    # Where two values differ in one bit or two, they meet twice; where they are equal, once for each bit.
    once = "(fa < fb or fa = 0 and fb = 0) and (ga < gb or ga = 0 and gb = 0)"
    return a.join(b, keys).filter(f"a < b and {once}").select("a", "b", "ha", "hb")


def similar_pairs(hashes: DataFrame, near: int = NEAR) -> DataFrame:
    """``a, b, distance`` for rows (``pos, hash``) whose 64-bit hashes differ in at most ``near`` bits.

    Equal hashes form one class first, so that copies of one picture make no pairs: they
    are chained to the first of their class.
    """
    classes = hashes.groupBy("hash").agg(F.min("pos").alias("pos"))
    copies = hashes.join(classes.select("hash", F.col("pos").alias("a")), "hash").filter("pos <> a").select("a", F.col("pos").alias("b"), F.lit(0).alias("distance"))
    found = candidates(classes, near).select("a", "b", media.hamming(F.col("ha"), F.col("hb")).alias("distance")).filter(F.col("distance") <= near).distinct()
    return found.unionByName(copies)


def _alike(reps: DataFrame, near: DataFrame) -> DataFrame:
    """``a, b``: links between pictures (``pos, hash, frame``) of equal or near hashes whose grey values differ by ``ALIKE`` at most.

    Pictures that are alike differ as little in their mean, so they stand in one cell of means
    or in neighbouring ones.  In a cell all are compared with its first picture; only cells
    that then still hold several components are compared in full, across components.
    """
    level = F.aggregate("frame", F.lit(0).cast("double"), lambda s, x: s + x, lambda s: s / F.size("frame"))
    rows = reps.filter("frame is not null").withColumn("cell", F.floor(level / ALIKE).cast("int"))
    within = media.mean_difference(F.col("frame"), F.col("other")) <= ALIKE
    pivot = rows.groupBy("hash", "cell").agg(F.min_by(F.struct("pos", "frame"), "pos").alias("x")).select("hash", "cell", F.col("x.pos").alias("a"), F.col("x.frame").alias("other"))
    first = keep(rows.join(pivot, ["hash", "cell"]).filter((F.col("pos") != F.col("a")) & within).select("a", F.col("pos").alias("b")), "picture-links")
    label = connected_components(first, "a", "b").select(F.col("node").alias("pos"), "component")
    rows = keep(rows.join(label, "pos", "left").withColumn("label", F.coalesce("component", "pos")).drop("component"), "pictures")
    both = near.select("ha", "hb").union(near.select(F.col("hb"), F.col("ha"))).union(rows.select(F.col("hash").alias("ha"), F.col("hash").alias("hb")).distinct())
    cells = rows.groupBy("hash", "cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    left = cells.select(F.col("hash").alias("ha"), F.explode(F.array(F.col("cell") - 1, "cell", F.col("cell") + 1)).alias("cb"), F.col("cell").alias("ca"), F.col("lo").alias("la"), F.col("hi").alias("ma"))
    right = cells.select(F.col("hash").alias("hb"), F.col("cell").alias("cb"), "lo", "hi")
    open_cells = left.join(both, "ha").join(right, ["hb", "cb"]).filter("least(la, lo) < greatest(ma, hi) and (ha < hb or ha = hb and ca <= cb)").select("ha", "ca", "hb", "cb")
    x = rows.select(F.col("hash").alias("ha"), F.col("cell").alias("ca"), F.col("pos").alias("a"), "frame", F.col("label").alias("la"))
    y = rows.select(F.col("hash").alias("hb"), F.col("cell").alias("cb"), F.col("pos").alias("b"), F.col("frame").alias("other"), F.col("label").alias("lb"))
    more = x.join(open_cells, ["ha", "ca"]).join(y, ["hb", "cb"]).filter((F.col("la") != F.col("lb")) & within).select("a", "b")
    return first.union(more)


def still_groups(records: DataFrame) -> DataFrame:
    """``pos, group`` for still pictures alike, by single links; groups count from 1 in the order of their first member.

    ``records``: ``pos, hash, low_motion, frame`` (an array of grey values or null).  Pictures
    decide where both are there; a record without one is like all of near hashes.
    """
    still = records.filter("low_motion and hash is not null").select("pos", "hash", "frame", F.concat("hash", F.coalesce(F.sha2(F.to_json(F.array("frame")), 256), F.lit(""))).alias("same"))
    # Joined with itself, and the optimizer can't bind the expressions of the hashes behind an aggregate of large tables.
    still = keep(still, "stills")
    first = still.groupBy("same").agg(F.min("pos").alias("a"))
    copies = still.join(first, "same").filter("pos <> a").select("a", F.col("pos").alias("b"))
    reps = keep(still.join(first.select(F.col("a").alias("pos")), "pos", "left_semi").select("pos", "hash", "frame"), "pictures")
    hashes = reps.groupBy("hash").agg(F.min("pos").alias("pos"))
    named = lambda x: hashes.select(F.col("pos").alias(x), F.col("hash").alias(f"h{x}"))
    near = keep(similar_pairs(hashes.select("pos", "hash")).join(named("a"), "a").join(named("b"), "b").select("ha", "hb"), "near-hashes")
    # One record for each hash at most has no picture here, as copies are taken out.
    blind = reps.filter("frame is null").select(F.col("pos").alias("a"), "hash")
    reach = near.select(F.col("ha").alias("hash"), F.col("hb").alias("to")).union(near.select(F.col("hb"), F.col("ha"))).union(blind.select("hash", F.col("hash").alias("to")))
    stars = blind.join(reach, "hash").join(reps.select(F.col("hash").alias("to"), F.col("pos").alias("b")), "to").filter("a <> b").select("a", "b")
    found = keep(connected_components(copies.union(stars).union(_alike(reps, near)), "a", "b"), "picture-groups")
    numbered = placed(found.select("component").distinct(), "component", name="group").withColumn("group", F.col("group").cast("long"))
    return found.join(numbered, "component").select(F.col("node").alias("pos"), "group")


def placeholders(records: DataFrame, groups: DataFrame) -> DataFrame:
    """``records`` with ``placeholder_group`` and ``placeholder``: a picture that several channels show; ``ok`` ones lose that status."""
    both = records.join(groups, "pos", "left").withColumnRenamed("group", "placeholder_group")
    spread = both.filter("placeholder_group is not null").groupBy("placeholder_group").agg(F.count_distinct("channel_key").alias("channels")).filter("channels > 1").select("placeholder_group", F.lit(True).alias("placeholder"))
    marked = both.join(spread, "placeholder_group", "left").withColumn("placeholder", F.coalesce("placeholder", F.lit(False)))
    return marked.withColumn("status", F.when(F.col("placeholder") & (F.col("status") == "ok"), "placeholder").otherwise(F.col("status")))
