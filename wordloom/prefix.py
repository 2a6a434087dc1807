"""Running totals over rows in a global order, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.bounds import settled


def running_totals(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows of the same group.

    ``df`` is narrow and stored (it is read twice, for the range bounds and for the rows). ``group`` columns hold no
    nulls; ``order`` may. Rows are range-partitioned by group and order, so a group with a third of all rows is spread
    over a third of the partitions, and stored with their partition's number. The totals per group and partition, at
    most groups + partitions rows, then give each partition's start; inside it a window adds up. Rows equal in
    all of ``order`` may change places among themselves. An empty table gives an empty table.
    """
    keys = [*group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settled(placed.withColumn("_part", F.spark_partition_id()))
    zero = F.lit(0).cast("long")
    held = placed.groupBy(*group, "_part").agg(F.sum(value).alias("_held"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(*group, "_part", F.coalesce(F.sum("_held").over(before), zero).alias("_start"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), zero))
    joined = summed.join(starts, [*group, "_part"])
    return joined.withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside", "_part")
