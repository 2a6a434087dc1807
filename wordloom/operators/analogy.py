"""Word analogies a:b :: c:d, solved by nearest search and graded.

A problem table has ``problem_id, category, a, b, c, d`` with unique ``problem_id``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.bounds import settled, small_or_settled
from wordloom.functions.vectors import UNIT_TOLERANCE, query_vector, vec_norm
from wordloom.operators.lookup import find_words, folded
from wordloom.operators.nearest import QUERY_BYTES, find_nearest_multi
from wordloom.operators.stats import PERCENTILES, describe

METRICS = ("euclidean", "cosine")
SIDES = ("all", "correct", "incorrect")
SCORE_BINS = 10


def problem_words(problems: DataFrame) -> DataFrame:
    """The distinct words of all problems."""
    return problems.select(F.explode(F.array("a", "b", "c", "d")).alias("word")).distinct()


def query_vectors(df: DataFrame, problems: DataFrame) -> DataFrame:
    """``problem_id, vector`` with vector ``b - a + c``, for the problems whose first three words are all known."""
    return _query_vectors(_looked_up(df, problem_words(problems)), problems)


def _query_vectors(found: DataFrame, problems: DataFrame) -> DataFrame:
    joined = problems.select("problem_id", "a", "b", "c")
    for name in ("a", "b", "c"):
        side = found.select(F.col("query").alias(name), F.col("vector").alias(f"{name}_vector"))
        joined = joined.join(side.hint("merge"), name)
    return joined.select("problem_id", query_vector("a_vector", "b_vector", "c_vector").alias("vector"))


def _looked_up(df: DataFrame, words: DataFrame) -> DataFrame:
    """The words with their rows, settled. Vectors are joined three times, always by shuffle: the size of their files,
    by which Spark would choose, is far below that of the rows it would fetch to copy them."""
    return settled(find_words(df, words))


def unsolvable_problems(df: DataFrame, problems: DataFrame) -> DataFrame:
    """The problems of which at least one of the first three words is unknown."""
    return problems.join(query_vectors(df, problems).select("problem_id"), "problem_id", "left_anti")


def use_normalized_path(df: DataFrame, tolerance: float = UNIT_TOLERANCE) -> bool:
    """Whether every vector of the table has length 1 within ``tolerance``."""
    worst = df.agg(F.max(F.abs(vec_norm("vector") - 1.0)).alias("worst")).head()["worst"]
    return worst is not None and worst <= tolerance


def solve_analogies(
    df: DataFrame,
    problems: DataFrame,
    normalized: bool = False,
    exclude_inputs: bool = False,
    broadcast_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The nearest word to each query vector by euclidean distance and by cosine similarity, from one pass.

    Two rows per problem: ``problem_id, category, a, b, c, d, metric, word, score, solved, correct``. A problem with
    an unknown word gets an empty answer of score 0. The words of the problem may be the answer unless
    ``exclude_inputs`` is set. With ``normalized``, a table of unit vectors is scored by inner product alone.
    """
    return _solved(df, problems, problem_words(problems), normalized, exclude_inputs, broadcast_bytes)


def _solved(
    df: DataFrame, problems: DataFrame, words: DataFrame, normalized: bool, exclude_inputs: bool, broadcast_bytes: int
) -> DataFrame:
    cosine = "normalized_cosine" if normalized and use_normalized_path(df) else "cosine"
    found = _looked_up(df, words)
    queries = _query_vectors(found, problems).withColumnRenamed("problem_id", "qid")
    # The three input rows fill at most three places, so the fourth best is enough to answer without them.
    depth = 4 if exclude_inputs else 1
    nearest = find_nearest_multi(df, queries, depth, ["euclidean", cosine], broadcast_bytes).withColumnRenamed("qid", "problem_id")
    if exclude_inputs:
        nearest = _without_inputs(found, problems, nearest)
    answers = nearest.select(
        "problem_id",
        F.when(F.col("metric") == "euclidean", "euclidean").otherwise("cosine").alias("metric"),
        F.col("word").alias("answer"),
        "score",
    )
    asked = problems.select(
        "problem_id", "category", "a", "b", "c", "d", F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric")
    )
    graded = asked.join(answers, ["problem_id", "metric"], "left")
    return graded.select(
        "problem_id",
        "category",
        "a",
        "b",
        "c",
        "d",
        "metric",
        F.coalesce("answer", F.lit("")).alias("word"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.col("answer").isNotNull().alias("solved"),
        F.coalesce(folded("answer") == folded("d"), F.lit(False)).alias("correct"),
    )


def _without_inputs(found: DataFrame, problems: DataFrame, nearest: DataFrame) -> DataFrame:
    known = found.select(F.col("query").alias("input"), F.col("index").alias("input_index"))
    inputs = problems.select("problem_id", F.explode(F.array("a", "b", "c")).alias("input")).join(known, "input")
    inputs = inputs.select("problem_id", F.col("input_index").alias("index")).distinct()
    best = nearest.join(inputs, ["problem_id", "index"], "left_anti")
    first = F.min(F.struct("rank", "word", "score")).alias("first")
    return best.groupBy("problem_id", "metric").agg(first).select("problem_id", "metric", "first.word", "first.score")


def algorithm_performance(results: DataFrame, group: tuple[str, ...] = ("category",)) -> DataFrame:
    """Accuracy and score statistics: one row per group, metric and side (all, correct, incorrect answers).

    Accuracy is correct answers over all problems, unsolved ones counting as wrong. A side without answers has zero
    statistics and an empty histogram.
    """
    keys = [*group, "metric"]
    own_side = F.when(F.col("correct"), "correct").otherwise("incorrect")
    sided = results.select(*keys, "score", F.explode(F.array(F.lit("all"), own_side)).alias("side"))
    stats = describe(sided, [*keys, "side"], "score", SCORE_BINS)
    totals = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("test_count"),
        F.try_divide(F.sum(F.col("correct").cast("int")), F.count(F.lit(1))).alias("accuracy"),
    )
    every = totals.withColumn("side", F.explode(F.array(*[F.lit(s) for s in SIDES])))
    numbers = ["max", "min", "mean", "stdev", "variance", *[f"p{p}" for p in PERCENTILES]]
    return every.join(stats, [*keys, "side"], "left").select(
        *keys,
        "side",
        "test_count",
        "accuracy",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in numbers],
        F.coalesce("histogram", F.array().cast("array<bigint>")).alias("histogram"),
    )


def incorrect_results(results: DataFrame, group: tuple[str, ...] = ("category",)) -> DataFrame:
    """The problems that at least one metric answered wrongly, with both answers side by side."""

    def of(metric: str, column: str):
        return F.max(F.when(F.col("metric") == metric, F.col(column))).alias(f"{metric}_{column}")

    wide = results.groupBy(*group, "problem_id", "a", "b", "c", "d").agg(
        *[of(m, c) for m in METRICS for c in ("word", "score", "correct")]
    )
    return wide.filter("not (euclidean_correct and cosine_correct)")


def evaluate(
    models: Mapping[str, DataFrame], problems: DataFrame, normalized: bool = False, exclude_inputs: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Every model against every category: the performance table and the wrongly answered problems."""
    words = small_or_settled(problem_words(problems))
    solved = [
        _solved(df, problems, words, normalized, exclude_inputs, QUERY_BYTES).withColumn("model", F.lit(name))
        for name, df in models.items()
    ]
    results = settled(reduce(DataFrame.unionByName, solved))
    group = ("model", "category")
    return algorithm_performance(results, group), incorrect_results(results, group)
