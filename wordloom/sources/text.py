"""Word vectors as text: one word and its numbers per line, separated by single spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.order import read_lines, with_file_index


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order, cut into the word and its number strings. Blanks at the end of a line are not data."""
    lines = with_file_index(read_lines(spark, path))
    parts = F.split(F.rtrim("value"), " ")
    return lines.select("index", "value", "file", parts.alias("parts"))


def _numbers():
    """The numbers of a line; NULL, as a whole or in place of an element, where a part is none, whatever the session says."""
    return F.transform(F.expr("slice(parts, 2, greatest(size(parts) - 1, 0))"), lambda x: x.try_cast("double"))


def read_text_vectors(spark: SparkSession, path: str, on_error: str = "fail", partitions: int | None = None) -> DataFrame:
    """The word table of text files, plain or .gz; ``index`` is the line number from 0 in file order.

    A line with a part that is not a number fails the read, or is left out with ``on_error="drop"`` and can be had
    from ``read_text_rejects``. A .gz file is one split, so its rows are spread over ``partitions`` (three per core
    unless given) for the steps that follow.
    """
    if on_error not in ("fail", "drop"):
        raise ValueError("on_error must be 'fail' or 'drop'")
    lines = _parsed(spark, path)
    compressed = str(path).endswith(".gz")
    if compressed or partitions is not None:
        lines = lines.repartition(partitions or spark.sparkContext.defaultParallelism * 3, "index")
    rows = lines.select("index", F.col("parts")[0].alias("word"), _numbers().alias("vector"), "file")
    if on_error == "drop":
        return rows.filter(_complete("vector")).drop("file")
    message = F.concat(F.lit("not a number in line "), F.col("index").cast("string"), F.lit(" of "), F.col("file"))
    sure = F.when(_complete("vector"), F.col("vector")).otherwise(F.raise_error(message).cast("array<double>"))
    return rows.select("index", "word", sure.alias("vector"))


def read_text_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``read_text_vectors`` cannot turn into numbers: ``index, file, line``."""
    lines = _parsed(spark, path).withColumn("vector", _numbers())
    return lines.filter(~_complete("vector")).select("index", "file", F.col("value").alias("line"))


def _complete(column: str):
    return F.col(column).isNotNull() & F.coalesce(~F.exists(column, lambda x: x.isNull()), F.lit(False))
