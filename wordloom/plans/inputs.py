"""Word tables, queries, problems and start centroids derived from the given tables, always from all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.vectors import as_vector, vec_add, vec_scale
from wordloom.operators.kernels import matrix
from wordloom.sources.binary import located


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a word table, the word being ``w`` and the id."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("index"),
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
        as_vector("embedding").alias("vector"),
    )


def cased_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``words`` with two spellings per word that differ only in case."""
    letter = F.when(F.col("index") % 2 == 0, "w").otherwise("W")
    return words(spark, sf_dir).withColumn("word", F.concat(letter, F.floor(F.col("index") / 2).cast("string")))


def stretched_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``words`` with vectors of different lengths, so that distance and angle rank rows differently."""
    return words(spark, sf_dir).withColumn("vector", vec_scale("vector", 1 + F.col("index") % 5))


def neighbours(df: DataFrame) -> DataFrame:
    """Every row with the next one: ``index, a, b``."""
    following = df.select((F.col("index") - 1).alias("index"), F.col("vector").alias("b"))
    return df.select("index", F.col("vector").alias("a")).join(following, "index")


def neighbour_sums(df: DataFrame) -> DataFrame:
    """A query per row: the sum of its vector and the next: ``qid, vector``."""
    return neighbours(df).select(F.col("index").alias("qid"), vec_add("a", "b").alias("vector"))


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analogy per row of the embeddings from four words that follow one another; the last ones use unknown words.

    The expected word is by turns the third word, the second in capitals, or the fourth, so some answers are right.
    """
    i = F.col("vec_id")

    def word(step: int, letter: str = "w"):
        return F.concat(F.lit(letter), (i + step).cast("string"))

    expected = F.when(i % 3 == 0, word(2)).when(i % 3 == 1, word(1, "W")).otherwise(word(3))
    return table(spark, sf_dir, "embeddings").select(
        i.alias("problem_id"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
        word(0).alias("a"),
        word(1).alias("b"),
        word(2).alias("c"),
        expected.alias("d"),
    )


def binary_files(df: DataFrame, folder: str, rows_per_file: int = 1_000_000) -> list[tuple[int, str]]:
    """The word table as binary vector files of ``rows_per_file`` consecutive rows each: their numbers and paths."""
    file = F.floor(F.col("index") / rows_per_file).cast("long")
    numbered = df.withColumn("file", file)
    held = {r["file"]: r["count"] for r in numbered.groupBy("file").count().collect()}
    system, inner = located(folder)
    system.create_dir(inner)
    sorted_rows = numbered.repartition(len(held) or 1, "file").sortWithinPartitions("file", "index")

    def write(batches):
        system, inner = located(folder)
        current, out = None, None
        for batch in batches:
            vectors = matrix(batch.column("vector")).astype("<f4")
            for number, word, vector in zip(batch.column("file").to_pylist(), batch.column("word").to_pylist(), vectors):
                if number != current:
                    if out is not None:
                        out.close()
                    current, out = number, system.open_output_stream(f"{inner}/{number}.bin")
                    out.write(f"{held[number]} {len(vector)}\n".encode())
                out.write(word.encode() + b" " + vector.tobytes() + b"\n")
        if out is not None:
            out.close()
        yield from ()

    sorted_rows.mapInArrow(write, "file long").count()
    return [(number, f"{folder}/{number}.bin") for number in sorted(held)]


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label as a centroid table."""
    elements = table(spark, sf_dir, "embeddings").select("label", F.posexplode(as_vector("embedding")).alias("pos", "x"))
    means = elements.groupBy("label", "pos").agg(F.avg("x").alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy(F.col("label").alias("cluster")).agg(F.transform(ordered, lambda e: e["mean"]).alias("center"))
