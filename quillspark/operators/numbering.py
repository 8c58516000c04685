"""Dense numbers over a total order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import Scratch


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Rows with their place in an order, from 1. The order must be total, or equal rows get any of their numbers.

    Ranges are sorted apart; a row per range tells each how many rows are before it. The ranges are written to the shared folder
    first: bounds are sampled, so a range computed twice might not have the same rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place"))
    placed = Scratch(rows.sparkSession, "numbered").table(placed, "placed")
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_place") + 1).drop("_part", "_place", "_base")
