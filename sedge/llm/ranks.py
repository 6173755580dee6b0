"""Ranks and sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.storage import saved


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a 1-based rank over the whole table: rows are range-partitioned, numbered inside each part, and shifted by the sizes of the parts before.

    Only one row per part meets in one task. ``order`` should be a total order; equal rows get ranks in any order.
    """
    parts = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_here", here).join(F.broadcast(shifts), "_part").withColumn(name, (F.col("_shift") + F.col("_here")).cast("long")).drop("_part", "_here", "_shift")
