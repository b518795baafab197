"""Matching a wanted list with candidate pools, exactly and then by ever looser rules."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallowick.functions import titles

MIN_LENGTH, EXCESS = 5, 3
RATIOS = {"normal": 0.86, "relaxed": 0.72}
MARGIN = 0.03


def exact(wanted: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """``wanted`` with ``pool_key``, null where no pool has the key."""
    return wanted.join(keys.select(F.col(key).alias("pool_key")).distinct(), F.col(key) == F.col("pool_key"), "left")


def _cuts(key: str, head: bool) -> F.Column:
    """All beginnings or endings of a key that are at least ``MIN_LENGTH`` characters long."""
    n = F.length(key)
    part = (lambda i: F.substring(F.col(key), F.lit(1), i)) if head else (lambda i: F.substr(F.col(key), n - i + 1, i))
    return F.when(n >= MIN_LENGTH, F.transform(F.sequence(F.lit(MIN_LENGTH), n), part))


def by_affix(wanted: DataFrame, pools: DataFrame) -> DataFrame:
    """``key, pool_key, stage`` for wanted keys that a pool's key resembles.

    Stages in order, the first that applies counts: with or without a leading
    ``UAND``; a pool's key goes on after the wanted one; the wanted one goes on after a
    pool's, by three characters at most; exactly one pool's key ends with it.  Of
    several the shortest, then the first.  A key begins or ends with another if one of its
    beginnings or endings equals it, so all joins are on whole keys, and the pools are
    reduced to the best hit before they are joined.  ``pools`` has ``key`` and ``pos``.
    """
    w = wanted.select(F.col("key").alias("want")).filter(F.length("key") >= MIN_LENGTH).distinct()
    p = pools.select("key", "pos", F.length("key").alias("n"))
    other = F.when(F.col("want").startswith("UAND"), F.substr("want", F.lit(5))).otherwise(F.concat(F.lit("UAND"), "want"))
    best = F.min(F.struct("n", "pos", "key")).alias("x")
    heads = p.select("key", "pos", "n", F.explode(_cuts("key", True)).alias("want")).filter("want <> key").groupBy("want").agg(best)
    ends = p.select("key", "pos", "n", F.explode(_cuts("key", False)).alias("want")).filter("want <> key").groupBy("want").agg(best, F.count("*").alias("hits")).filter("hits = 1").drop("hits")
    short = w.select("want", F.explode(_cuts("want", True)).alias("key")).filter(F.expr("key <> want") & (F.length("want") - F.length("key") <= EXCESS))
    hit = lambda stage, rows: rows.select("want", F.struct(F.lit(stage).alias("stage"), "x.n", "x.pos", "x.key").alias("x"))
    whole = F.struct("n", "pos", "key").alias("x")
    rows = hit(0, w.withColumn("key", other).join(p, "key").select("want", whole)).union(hit(1, w.join(heads, "want"))).union(hit(2, short.join(p, "key").select("want", whole))).union(hit(3, w.join(ends, "want")))
    return rows.groupBy("want").agg(F.min("x").alias("x")).select(F.col("want").alias("key"), F.col("x.key").alias("pool_key"), F.col("x.stage").alias("stage"))


# Letters from rare to frequent in names; any other sign counts as rarer.
_RARE = "qxjzvkwyfhgbpumdclotnrsaie "


def _letters(text: F.Column) -> F.Column:
    """A text's signs, each with its number among equal ones, in an order that is one for all texts: rare ones first."""
    signs = F.array_sort(F.filter(F.split(text, ""), lambda x: x != ""))
    numbered = F.transform(signs, lambda x, i: F.struct((F.array_position(signs, x) - i).alias("again"), F.position(x, F.lit(_RARE)).alias("rare"), x.alias("sign")))
    return F.array_sort(numbered)


def word_pairs(w: DataFrame, p: DataFrame, least: float) -> DataFrame:
    """The pairs of ``key, a`` and ``pool_key, pos, b`` whose texts' ratio may reach ``least``.

    A ratio of texts is at most twice their common signs by all their signs.  So it takes lengths
    that are not too far apart, and a number of common signs that leaves, of each text's
    signs in one order for all, only the first few without a common one (prefix filter).  Pairs meet
    under such a sign and the length of the pool's text, and count where they meet first.
    """
    share = least / (2 - least)
    size = F.length
    first = lambda c: F.slice(_letters(F.col(c)), F.lit(1), (size(c) - F.ceil(size(c) * share - 1e-9) + 1).cast("int"))
    lengths = F.sequence(F.ceil(size("a") * share - 1e-9), F.floor(size("a") / share + 1e-9))
    left = w.select("*", first("a").alias("_fa")).select("*", F.explode("_fa").alias("_sign")).select("*", F.explode(lengths).alias("_n"))
    right = p.select("*", first("b").alias("_fb"), size("b").cast("long").alias("_n")).select("*", F.explode("_fb").alias("_sign"))
    met = left.join(right, ["_sign", "_n"]).filter(F.array_intersect("_fa", "_fb")[0] == F.col("_sign"))
    total = F.length("a") + F.length("b")
    lacking = F.expr("length(translate(a, b, '')) + length(translate(b, a, ''))")
    return met.filter(total - lacking >= total * least).drop("_fa", "_fb", "_sign", "_n")


def by_words(wanted: DataFrame, pools: DataFrame, mode: str = "normal") -> DataFrame:
    """``key, pool_key, ratio`` for names whose words in order are alike, unless the two best are too close to tell.

    ``wanted`` has ``key, name`` and holds only what nothing else matched; ``pools`` has
    ``key, name, pos``, one row for each pool.
    """
    if mode not in RATIOS:
        return wanted.select("key", F.lit(None).cast("string").alias("pool_key"), F.lit(None).cast("double").alias("ratio")).limit(0)
    least = RATIOS[mode]

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            m = difflib.SequenceMatcher(None, x, y)
            out.append(m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0)
        return pd.Series(out, dtype=float)

    w = wanted.select("key", titles.token_set(F.col("name")).alias("a")).filter("a <> ''")
    p = pools.select(F.col("key").alias("pool_key"), "pos", titles.token_set(F.col("name")).alias("b")).filter("b <> ''")
    scored = word_pairs(w, p, least).withColumn("ratio", F.pandas_udf(ratio, "double")("a", "b")).filter(F.col("ratio") >= least)
    order = Window.partitionBy("key").orderBy(F.desc("ratio"), "pos")
    best = scored.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("ratio").over(order))
    return best.filter((F.col("place") == 1) & (F.col("second").isNull() | (F.col("ratio") - F.col("second") >= MARGIN))).select("key", "pool_key", "ratio")


def fill_blanks(wanted: DataFrame, reference: DataFrame, fields: tuple[str, ...] = ("number", "group"), key: str = "key") -> DataFrame:
    """``wanted`` with blank fields taken from ``reference``, and ``filled``: whether any was."""
    ref = reference.select(key, *(F.col(f).alias(f"ref_{f}") for f in fields))
    joined = wanted.join(ref, key, "left")
    blank = {f: F.col(f).isNull() | (F.col(f).cast("string") == "") for f in fields}
    filled = F.lit(False)
    for f in fields:
        filled = filled | (blank[f] & F.col(f"ref_{f}").isNotNull())
    return joined.withColumns({"filled": filled} | {f: F.when(blank[f], F.coalesce(f"ref_{f}", f)).otherwise(F.col(f)) for f in fields}).drop(*(f"ref_{f}" for f in fields))
