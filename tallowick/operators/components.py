"""Connected components of an edge table, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowick.storage import shared_dir


def _saved(df: DataFrame) -> DataFrame:
    """Cut the lineage through the checkpoint folder that executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    Each round takes the smallest label among a node and its neighbours, then
    replaces a label by that label's own label, so a chain of n nodes needs about
    log n rounds.  Loops and repeated edges are harmless; edges with a null end are
    ignored.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    both = _saved(pairs.union(pairs.select("y", "x")).distinct())
    labels = _saved(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        closer = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        # a label is itself a node; its own label is at least as small
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("up"))
        moved = _saved(closer.join(up, "mid").select("node", "old", F.least("mid", "up").alias("label")))
        labels = moved.select("node", "label")
        if moved.filter("label < old").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
