"""Analogy problems from text files, one file per category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.order import read_lines, with_file_index


def read_analogies(spark: SparkSession, path: str) -> DataFrame:
    """``problem_id, category, a, b, c, d`` from the files directly in a folder; the category is the file name."""
    lines = with_file_index(read_lines(spark, path, recursiveFileLookup="false"), "problem_id")
    words = F.split(F.rtrim("value"), " ")
    name = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B")))
    return lines.select(
        "problem_id", name.alias("category"), *[words[i].alias(c) for i, c in enumerate(("a", "b", "c", "d"))]
    )
