"""A Merkle manifest of a dataset as a rollup of nested structs.

Leaves are ranked within their tree (a group of rows, such as a language) and their rank
is written in digits to base ``FAN``.  Grouping the lowest digit away nests the rows of a
run into an array of structs and gives it the digest of its members' digests; so do the
next digits, one after the other.  ``LEVELS`` digits make a block, which is a row of bounded
size, ``FAN ** LEVELS`` leaves; the digests of the blocks are the leaves of the same rollup
again, until one is left for each tree, and those of the trees make the top tree.

Proofs come down the same way.  A block takes up the path above it by being grouped
with it, and transform and explode then unnest its runs, each child with its siblings added
in front of its path.  No proof is joined to a row.

Digest ``H``: lower-case hexadecimal SHA-256 of the inputs end to end, digests as their text.
A field counts as ``-`` if null, else as its bytes in UTF-8, ``:`` and the value.

Defined results: null ids come first in their tree, a null tree is a tree of its own and the
first; rows of equal ids follow in the order of reading, so repeated rows change no
digest; every row is a leaf; extra columns are ignored; an empty table has no rows and
no root.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallowick.llm.workspace import keep

FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(fields: Sequence[Column]) -> Column:
    """``H`` of a row's fields."""
    written = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*written), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def siblings(path: Column) -> Column:
    """``H`` of a path's siblings."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """``tree, id, item`` with ``pos``, the place in the tree from 0 on, and ``n``, the tree's rows.

    Ranges of the order are numbered each for itself, from the rows of the ranges before.
    """
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("tree", "id", "row").withColumn("range", F.spark_partition_id())
    dealt = keep(dealt, name)
    tree = Window.partitionBy("tree")
    # A row for each tree in each range.
    sizes = dealt.groupBy("tree", "range").count().select(F.col("tree").alias("of"), F.col("range").alias("in"), (F.sum("count").over(tree.orderBy("range")) - F.col("count")).alias("before"), F.sum("count").over(tree).alias("n"))
    own = F.row_number().over(Window.partitionBy("range", "tree").orderBy("id", "row"))
    met = dealt.withColumn("own", own).join(sizes, F.col("tree").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    return met.select("tree", "item", (F.col("before") + F.col("own") - 1).alias("pos"), "n")


def _blocks(nodes: DataFrame) -> DataFrame:
    """``tree, n, block, hash, below``: the blocks of ``tree, n, pos, item``, digits of the rank grouped away from the lowest on."""
    digit = [F.pmod(F.expr(f"pos div {FAN**i}"), F.lit(FAN)).cast("int").alias(f"d{i}") for i in range(LEVELS)]
    rows = nodes.select("tree", "n", F.expr(f"pos div {BLOCK}").alias("block"), *digit, F.col("item.hash").alias("hash"), F.struct("pos", "item").alias("below")).repartition("tree", "block")
    for level in range(LEVELS):
        left = ["tree", "n", "block", *(f"d{i}" for i in range(level + 1, LEVELS))]
        runs = rows.groupBy(*left).agg(F.array_sort(F.collect_list(F.struct(f"d{level}", "hash", "below"))).alias("below"))
        # A tree of one node is done.
        node = F.when(F.col("n") > FAN**level, F.sha2(F.array_join("below.hash", ""), 256)).otherwise(F.col("below")[0]["hash"])
        rows = runs.select(*left, node.alias("hash"), "below")
    return rows


def _unnested(blocks: DataFrame) -> DataFrame:
    """``tree, pos, item, path, facts`` from blocks with the path above them."""
    rows = blocks
    for level in reversed(range(LEVELS)):
        there = F.col("n") > FAN**level
        joined = lambda first, size: F.array_join(F.slice("below.hash", first, size), "")
        beside = lambda x, i: F.struct(x["below"].alias("below"), joined(F.lit(1), i).alias("left"), joined(i + 2, F.lit(FAN)).alias("right"))  # noqa: E731, B023
        rows = rows.select("tree", "n", "path", "facts", F.explode(F.transform("below", beside)).alias("x"))
        step = F.when(there, F.array(F.struct("x.left", "x.right"))).otherwise(F.array().cast(PATH))
        rows = rows.select("tree", "n", F.concat(step, "path").alias("path"), "facts", F.col("x.below").alias("below"))
    return rows.select("tree", "below.pos", "below.item", "path", "facts")


def _proved(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``tree, pos, item, path, facts`` of ``nodes``; ``above`` has them for the trees' tops, ``tree, pos, path, facts``."""
    blocks = keep(_blocks(nodes), f"{name}-blocks")
    tops = blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.struct("hash").alias("item"))
    most = blocks.agg(F.max("n")).first()[0] or 0
    upper = _proved(tops, above, name) if most > BLOCK else above(tops)
    upper = upper.select("tree", F.col("pos").alias("block"), "path", "facts")
    met = blocks.select("tree", "block", "n", "below").unionByName(upper, allowMissingColumns=True)
    return _unnested(met.groupBy("tree", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "below", "path", "facts"))))


def _over_trees(tops: DataFrame) -> DataFrame:
    """The tops' places in the tree of all trees: ``facts`` are a tree's root and the root of all."""
    named = _ranked(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("id"), F.struct("item.hash", F.col("tree").alias("name")).alias("item")), "trees")
    root = lambda x: x.select("tree", "pos", F.array().cast(PATH).alias("path"), F.col("item.hash").alias("facts"))
    return _proved(named, root, "top").select(F.col("item.name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.struct(F.col("item.hash").alias("subroot"), F.col("facts").alias("root")).alias("facts"))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang", altered: Sequence[Column] | None = None) -> DataFrame:
    """``id, tree, leaf, altered, subroot, root, path``: a row for each row of ``docs``.

    ``path`` has a step for each level from the leaf to the root, the digests to the
    ``left`` and ``right`` of the node in its run.  ``altered`` is the leaf of the fields
    given as ``altered``, for checks of changed rows, else the leaf again.
    """
    own = [F.col(f) for f in fields]
    item = F.struct(F.col(id_col).alias("id"), digest(own).alias("hash"), digest(altered if altered is not None else own).alias("altered"))
    leaves = _ranked(docs.select(F.col(tree_col).alias("tree"), F.col(id_col).alias("id"), item.alias("item")), "leaves")
    proved = _proved(leaves, _over_trees, "leaf")
    return proved.select("item.id", "tree", F.col("item.hash").alias("leaf"), "item.altered", "facts.subroot", "facts.root", "path")
