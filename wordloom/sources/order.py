"""Dense row numbers in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.bounds import settled, small_or_settled


def read_lines(spark, path: str | list[str], **options) -> DataFrame:
    """The lines of text files with the split each was read from: ``value, file, split_start, row_id``."""
    lines = spark.read.options(**options).text(path)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def with_file_index(lines: DataFrame, column: str = "index") -> DataFrame:
    """Number the rows of ``read_lines`` from 0 in file order, files in order of their path.

    The lines are stored once with the split and the id that this one scan gave them, and everything is taken from that
    copy: how a later scan would be cut does not matter. Row ids grow by one inside a split, so a row's place is its
    distance from the first id of the split plus the number of rows in all earlier splits. Only the table of splits
    is ordered; the rows are not shuffled. A row without its split's place fails the job.
    """
    lines = settled(lines)
    splits = lines.groupBy("file", "split_start").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("held"))
    files = splits.groupBy("file").agg(F.sum("held").alias("rows"))
    before_file = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before_split = Window.partitionBy("file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    files = files.select("file", F.coalesce(F.sum("rows").over(before_file), zero).alias("file_base"))
    offsets = (
        splits.withColumn("split_base", F.coalesce(F.sum("held").over(before_split), zero))
        .join(files, "file")
        .select("file", "split_start", "first_id", (F.col("file_base") + F.col("split_base")).alias("base"))
    )
    numbered = lines.join(small_or_settled(offsets), ["file", "split_start"], "left")
    place = F.col("base") + F.col("row_id") - F.col("first_id")
    found = F.coalesce(place, F.raise_error(F.lit("a line's split has no place")).cast("long"))
    return numbered.withColumn(column, found).drop("base", "first_id", "row_id", "split_start")
