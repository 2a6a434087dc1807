"""The best rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of a group that are ranked apart when more than 1000 rows are asked for.
PARTS = 64
# Below this many rows Spark by itself limits each partition to a group's best before the shuffle.
LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in the given order, with their position from 1.

    Each partition gives at most ``n`` rows per group to the shuffle, whatever ``n`` is: the session's limit for that is
    raised where needed. Beyond 1000 the rows of a group are first ranked in parts, one for each of ``PARTS`` classes of
    input partitions, and only the best ``n`` of each part meet, so a large group is ranked by as many tasks.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    window = Window.partitionBy(*group).orderBy(*order)
    if n > 1000:
        conf = df.sparkSession.conf
        if int(conf.get(LIMIT_SETTING)) <= n:
            conf.set(LIMIT_SETTING, str(n + 1))
        parted = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
        inside = Window.partitionBy(*group, "_part").orderBy(*order)
        df = parted.withColumn(rank, F.row_number().over(inside)).filter(F.col(rank) <= n).drop("_part", rank)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
