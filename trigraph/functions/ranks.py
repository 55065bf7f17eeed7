"""Global running totals and row numbers without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigraph.functions.lineage import cut


def running_total(df: DataFrame, order: Sequence[Column], weight: Column | None = None, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` (1 if None) over the rows that stand before each row in ``order``.

    Rows are range-partitioned and sorted, stored once, and only a total per range, as many rows as there are
    partitions, is summed in one place and sent back to all. ``order`` must be total for a repeatable result.
    """
    w = F.lit(1).cast("bigint") if weight is None else weight
    placed = cut(
        df.withColumn("__w", w)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__seq", F.monotonically_increasing_id())
    )
    ranges = placed.groupBy("__part").agg(F.sum("__w").alias("__sum"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    if weight is None:
        inside = F.col("__seq").bitwiseAND((1 << 33) - 1)
        numbered = placed
    else:
        rows = Window.partitionBy("__part").orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.col("__inside")
        numbered = placed.withColumn("__inside", F.coalesce(F.sum("__w").over(rows), F.lit(0)))
    out = numbered.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + inside)
    return out.drop("__w", "__part", "__seq", "__offset", "__inside")
