"""Time the heavy operators on generated word tables of two sizes, ten times apart.

Usage: python bench_scale.py [rows] [dimensions] ; the larger table has ten times ``rows``.
"""

import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wordloom.operators import clustering, nearest, stats


def words(spark, rows, dimensions, path):
    numbers = F.array(*[F.randn(i) for i in range(dimensions)])
    spark.range(rows).select(
        F.col("id").alias("index"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), numbers.alias("vector")
    ).write.parquet(path)
    return spark.read.parquet(path)


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 100_000
    dimensions = int(sys.argv[2]) if len(sys.argv) > 2 else 64
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", 2 * int(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="wordloom-bench-")
    for size in (rows, 10 * rows):
        df = words(spark, size, dimensions, f"{folder}/{size}")
        queries = df.filter(F.col("index") < 1000).select(F.col("index").alias("qid"), F.transform("vector", lambda x: x + 0.1).alias("vector"))
        centres = df.filter(F.col("index") < 100).select(F.col("index").cast("int").alias("cluster"), F.col("vector").alias("center"))
        jobs = {
            "nearest-1, 1000 queries, two metrics": lambda: nearest.find_nearest_multi(df, queries, 1, ["euclidean", "cosine"]),
            "nearest-10, 1000 queries": lambda: nearest.find_nearest_multi(df, queries, 10, "cosine"),
            "one query": lambda: nearest.find_nearest(df, [0.1] * dimensions, 10),
            "dimension statistics": lambda: stats.dimension_stats(df),
            "length statistics": lambda: stats.norm_stats(df),
            "assign 100 clusters": lambda: clustering.assign_clusters(df, centres),
            "k-means step": lambda: clustering.lloyd_step(df, centres),
        }
        for name, job in jobs.items():
            if size == rows:
                job().write.format("noop").mode("overwrite").save()
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            print(f"{size} x {dimensions}: {name}: {time.perf_counter() - start:.2f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
