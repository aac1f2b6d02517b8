"""Ranks over any number of rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.shared import kept


def ranked(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with `name`, the place of each row from 0 in the given order; rows equal in it are in any order.

    Rows are dealt to ranges of the order and written with their range's number, so that each range is
    ranked by itself; the ranges' offsets are an aggregate of one row each.
    """
    dealt = kept(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(F.lit(0)).orderBy("_range")
    offsets = sizes.select("_range", (F.sum("_n").over(every) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before")
