"""Places in an order of all rows, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallowick.storage import keep


def placed(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 on in a total order.

    Rows are dealt out by ranges of the order and numbered within each range, from the
    number of rows in the ranges before it.
    """
    dealt = keep(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    size = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # A row for each partition.
    before = size.alias("a").join(size.alias("b"), F.col("b._range") < F.col("a._range"), "left").groupBy(F.col("a._range").alias("_range")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return dealt.join(before, "_range").select(*rows.columns, place.alias(name))
