"""Dense positions for distinct values, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.stash import broadcast_if_small, stash


def level_index(df: DataFrame, column: str) -> DataFrame:
    """``(column, ix)``: position from 0 of each distinct non-null value in sorted order."""
    return numbered(df.where(F.col(column).isNotNull()).select(column).distinct(), column)


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """``rows``, unique in ``column``, with their position ``ix`` in its order.

    The rows are range-partitioned and sorted in parallel. Only the row count of each
    range, one number per task, is accumulated in a single place.
    """
    ranged = stash(
        rows.repartitionByRange(column).withColumn("range", F.spark_partition_id()), "ranges"
    )
    earlier = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        ranged.groupBy("range")
        .agg(F.count("*").alias("n"))
        .select("range", F.coalesce(earlier, F.lit(0)).alias("offset"))
    )
    place = F.row_number().over(Window.partitionBy("range").orderBy(column))
    return stash(
        ranged.withColumn("place", place)
        .join(broadcast_if_small(offsets), "range")
        .select(*rows.columns, (F.col("offset") + F.col("place") - 1).cast("int").alias("ix")),
        "numbered",
    )
