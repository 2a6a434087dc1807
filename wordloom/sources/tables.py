"""Stored forms: word tables, reports, centroids and text listings."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from wordloom.functions.vectors import as_vector, to_unit_vectors
from wordloom.operators.clustering import cluster_lines
from wordloom.operators.stats import PERCENTILES
from wordloom.sources.binary import read_binary_vectors
from wordloom.sources.text import read_text_vectors


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The word table of a stored model."""
    return spark.read.parquet(path).select(F.col("index").cast("long"), "word", as_vector("vector").alias("vector"))


def model_name(path: str) -> str:
    """Name of a model: the last part of its path, without the endings of input files."""
    return re.sub(r"\.(gz|txt|bin)(?=\.|$)", "", PurePosixPath(str(path).rstrip("/")).name)


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a word table as parquet with named columns."""
    df.select("index", "word", "vector").write.mode(mode).parquet(path)


def load_model(
    spark: SparkSession, inputs: list[str], format: str, output: str, dump: bool = False
) -> dict[str, tuple[str, str]]:
    """Store each input twice, as read and with unit vectors (``<name>-normalized``); returns both paths per name.

    ``format`` is ``text`` or ``binary``. With ``dump``, the rows are also written as text under ``<name>-dump.txt``.
    """
    readers = {"text": read_text_vectors, "binary": read_binary_vectors}
    if format not in readers:
        raise ValueError(f"format must be one of {sorted(readers)}")
    stored = {}
    for path in inputs:
        name = model_name(path)
        words = readers[format](spark, path).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            raw, unit = f"{output}/{name}", f"{output}/{name}-normalized"
            write_vectors(words, raw)
            write_vectors(to_unit_vectors(words), unit)
            if dump:
                dump_vectors(words, f"{output}/{name}-dump.txt")
        finally:
            words.unpersist()
        stored[name] = (raw, unit)
    return stored


def vector_lines(df: DataFrame) -> DataFrame:
    """One text line per row: index, word and comma-separated numbers, separated by tabs."""
    return df.select(
        F.concat_ws("\t", F.col("index").cast("string"), "word", F.concat_ws(",", F.col("vector").cast("array<string>"))).alias("line")
    )


def dump_vectors(df: DataFrame, path: str) -> None:
    """Write ``vector_lines`` as text files."""
    vector_lines(df).write.mode("overwrite").text(path)


def _nested_statistics():
    points = F.map_from_arrays(
        F.array(*[F.lit(f"{p:g}") for p in PERCENTILES]), F.array(*[F.col(f"p{p:g}") for p in PERCENTILES])
    )
    return F.struct("max", "min", "mean", "stdev", "variance", points.alias("percentiles"), "histogram")


def statistics_report(stats: DataFrame) -> DataFrame:
    """One row per model from the rows of ``analyze``: the statistics of every dimension in order, and of the lengths."""
    rows = stats.select("model", "words", "dimensionality", "dimension", _nested_statistics().alias("s"))
    dimension = F.when(F.col("dimension").isNotNull(), F.struct("dimension", "s"))

    def by_dimension(a, b):
        return a["dimension"] - b["dimension"]

    return rows.groupBy("model").agg(
        F.first("words").alias("words"),
        F.first("dimensionality").alias("dimensionality"),
        F.transform(F.array_sort(F.collect_list(dimension), by_dimension), lambda d: d["s"]).alias("dimension_stats"),
        F.first(F.when(F.col("dimension").isNull(), F.col("s")), ignorenulls=True).alias("norm_stats"),
    )


def evaluation_report(performance: DataFrame) -> DataFrame:
    """One row per model and category, from the rows of ``evaluate``: accuracy and statistics per metric.

    The wrongly answered problems can be many and are written as a table of their own.
    """
    rows = performance.select("model", "category", "metric", "side", "test_count", "accuracy", _nested_statistics().alias("s"))

    def of(metric: str, side: str):
        mine = (F.col("metric") == metric) & (F.col("side") == side)
        return F.first(F.when(mine, F.col("s")), ignorenulls=True)

    def performance_of(metric: str):
        accuracy = F.max(F.when(F.col("metric") == metric, F.col("accuracy"))).alias("accuracy")
        sides = (("stats", "all"), ("correct_stats", "correct"), ("incorrect_stats", "incorrect"))
        return F.struct(accuracy, *[of(metric, side).alias(name) for name, side in sides]).alias(f"{metric}_performance")

    return rows.groupBy("model", "category").agg(
        F.max("test_count").alias("test_count"), performance_of("euclidean"), performance_of("cosine")
    )


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a report as JSON lines."""
    report.write.mode(mode).json(path)


def state_name(model: str, k: int, runs: int, iteration: int) -> str:
    """Name of a stored training state."""
    return f"{model}-kmeans-k-{k}-runs-{runs}-iteration-{iteration}.model"


# Written into a state's folder behind all of its rows; a state without it was cut off.
COMPLETE = "_complete"


def _files(spark: SparkSession, path: str):
    """A path and its file system, as Spark reaches it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_centroids(centroids: DataFrame, path: str, model: str, k: int, runs: int, iteration: int) -> str:
    """Store a training state under its name in ``path`` and mark it complete; returns where.

    A state of that name loses its mark first, so a state that is written again and cut off is not taken for whole.
    """
    target = f"{path}/{state_name(model, k, runs, iteration)}"
    mark, files = _files(centroids.sparkSession, f"{target}/{COMPLETE}")
    files.delete(mark, False)
    centroids.select("cluster", "center").write.mode("overwrite").parquet(target)
    files.create(mark, True).close()
    return target


def last_complete_step(spark: SparkSession, path: str, model: str, k: int, runs: int) -> tuple[int, DataFrame] | None:
    """The iteration and centres of the last state in ``path`` that was stored whole, to resume from; None if there is none."""
    place, files = _files(spark, path)
    if not files.exists(place):
        return None
    named = re.compile(re.escape(state_name(model, k, runs, 0)).replace(r"iteration\-0", r"iteration\-(\d+)"))
    steps = []
    for status in files.listStatus(place):
        found = named.fullmatch(status.getPath().getName())
        if found and files.exists(_files(spark, f"{status.getPath()}/{COMPLETE}")[0]):
            steps.append(int(found[1]))
    return (max(steps), load_centroids(spark, path, model, k, runs, max(steps))) if steps else None


def load_centroids(spark: SparkSession, path: str, model: str, k: int, runs: int, iteration: int) -> DataFrame:
    """A stored training state."""
    return spark.read.parquet(f"{path}/{state_name(model, k, runs, iteration)}").select("cluster", "center")


def write_cluster_lines(df: DataFrame, centroids: DataFrame, path: str, single_file: bool = False) -> None:
    """Write the members of each cluster as text lines, clusters in order of their most frequent word."""
    lines = cluster_lines(df, centroids).orderBy("representative_index", "part").select("line")
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)


def union_models(models: Mapping[str, DataFrame]) -> DataFrame:
    """Several word tables as one, with a ``model`` column."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("model"), "index", "word", "vector") for name, df in models.items()])
