"""Numbers by place in an order: running sums and gap-free keys, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dirlake.sources.shared import cut


def running_sum(rows: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """rows with name: the sum of column over all rows that stand earlier in the order; rows of equal keys stand in any order.

    Rows are sorted by range and written, so that places don't change any more; sums within a partition are added to those of
    the partitions before it, of which there is one row each.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(sorted_rows, "ordered").withColumn("_part", F.shiftright("_at", 33))
    totals = placed.groupBy("_part").agg(F.sum(column).alias("_sum"))
    totals = totals.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_earlier"))
    here = F.sum(column).over(Window.partitionBy("_part").orderBy("_at")) - F.col(column)
    return placed.withColumn("_here", here).join(totals, "_part").withColumn(name, F.col("_here") + F.col("_earlier")).drop("_at", "_part", "_here", "_earlier")


def with_keys(rows: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """rows with name: after + 1, after + 2, ... in the order, without gaps."""
    out = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one", name)
    return out.withColumn(name, F.col(name) + F.lit(after + 1)).drop("_one")
