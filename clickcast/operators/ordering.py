"""Global orders whose position is a column, without one task that sorts everything.

A sorted result loses its order as soon as it is written in parts or joined, so the reports carry
their positions.  Rows are dealt into ranges of the order and written; the ranges' sizes are
counted and summed up (a row a range), and a row's position is its range's offset plus its
``row_number`` within the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickcast.session import materialised


def with_positions(df: DataFrame, *order: Column | str, name: str = "position", ranges: int | None = None) -> DataFrame:
    """``df`` plus its rows' positions (from 1) in ``order``.

    ``order`` must end in columns that make it total: rows equal in all of it share a range and take
    positions of their own in any order.  An empty table gives no rows.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialised(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_m"))  # at most `ranges` rows
    before = sizes.select("_range", (F.sum("_m").over(Window.partitionBy().orderBy("_range")) - F.col("_m")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(
        name, (F.col("_before") + F.col("_place")).cast("long")).drop("_range", "_place", "_before")
