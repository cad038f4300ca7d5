"""Positions of rows in a total order, counted by all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.plans.lineage import cut


def with_positions(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """``df`` with the place of each row in the order, from 0 and without gaps.

    Rows are sorted by ranges; a row's place is that in its partition plus the
    rows of the partitions before it.  What is broadcast and what one window
    holds is a count per partition.  Rows that are equal in ``order`` come in
    any order.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Ids within a partition are consecutive, below the bits of its number.
    rows = cut(rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")
