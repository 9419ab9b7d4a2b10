"""Positions in an order, without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` (stored) with its rows' positions from 0 in the order of ``order``, as a long column ``name``.

    Rows are dealt to ranges of the order and numbered within them; what stands before a range comes from a table of
    a row per range.  Rows that are equal in ``order`` stay together and are numbered in any order.
    """
    spark = df.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = {f"_o{i}": k for i, k in enumerate(keys)}
    ranged = df.withColumns(named).repartitionByRange(width, *named).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*named)) - 1
    placed = ranged.withColumn(name, within).join(F.broadcast(offsets), "_range")  # a row per range
    return placed.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before", *named)
