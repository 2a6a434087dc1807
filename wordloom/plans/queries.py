"""The registered queries: each operator over whole tables, with scalar columns rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.bounds import scratch
from wordloom.functions import vectors as V
from wordloom.operators import analogy, bounded, clustering, lookup, nearest, stats, topn
from wordloom.plans import inputs
from wordloom.sources import analogies, binary, tables, text

POINTS = [f"p{p}" for p in stats.PERCENTILES]
NUMBERS = ["max", "min", "mean", "stdev", "variance", *POINTS]


def r6(column, name: str | None = None):
    name = name or column
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name)


def rounded(*names: str):
    return [r6(n) for n in names]


def elements(df: DataFrame, *keys: str) -> DataFrame:
    """One row per vector element."""
    rows = df.select(*keys, F.posexplode("vector").alias("pos", "x"))
    return rows.select(*keys, "pos", r6("x", "value"))


# Vector columns


def vector_sum(spark, d):
    return elements(inputs.neighbours(inputs.words(spark, d)).withColumn("vector", V.vec_add("a", "b")), "index")


def vector_difference(spark, d):
    return elements(inputs.neighbours(inputs.words(spark, d)).withColumn("vector", V.vec_sub("a", "b")), "index")


def pair_scores(spark, d):
    pairs = inputs.neighbours(inputs.stretched_words(spark, d))
    return pairs.select(
        "index",
        r6(V.vec_dot("a", "b"), "dot"),
        r6(V.euclidean("a", "b"), "euclidean"),
        r6(V.squared_distance("a", "b"), "squared_distance"),
        r6(V.cosine_similarity("a", "b"), "cosine_similarity"),
        r6(V.cosine_distance("a", "b"), "cosine_distance"),
    )


def normalized_cosine(spark, d):
    pairs = inputs.neighbours(V.to_unit_vectors(inputs.stretched_words(spark, d)))
    return pairs.select("index", r6(V.normalized_cosine("a", "b"), "score"))


def vector_norm(spark, d):
    return inputs.stretched_words(spark, d).select("index", r6(V.vec_norm("vector"), "norm"))


def normalized_check(spark, d):
    df = inputs.words(spark, d).withColumn("unit", V.unit_vector("vector"))
    return df.select(
        "index",
        V.is_normalized("vector", 1e-5).alias("stored_is_unit"),
        V.is_normalized(V.vec_scale("vector", F.lit(1.5))).alias("longer_is_unit"),
        V.is_normalized("unit").alias("scaled_is_unit"),
    )


def unit_vectors(spark, d):
    return elements(V.to_unit_vectors(inputs.stretched_words(spark, d)), "index")


def analogy_query_vectors(spark, d):
    return elements(analogy.query_vectors(inputs.words(spark, d), inputs.problems(spark, d)), "problem_id")


# Lookups


def find_all_words(spark, d):
    return lookup.find_all(inputs.words(spark, d), F.col("vector")[0] > 0).select("index", "word")


def find_first_words(spark, d):
    return lookup.find(inputs.words(spark, d), F.col("vector")[0] > 0, 20).select("index", "word")


def find_word(spark, d):
    return lookup.find_word(inputs.cased_words(spark, d), "W7").select("index", "word", r6(F.col("vector")[0], "first"))


def find_words(spark, d):
    df = inputs.cased_words(spark, d)
    wanted = inputs.words(spark, d).select(F.upper("word").alias("word"))
    return lookup.find_words(df, wanted).select("query", "index", "word", r6(F.col("vector")[0], "first"))


def find_words_case_sensitive(spark, d):
    wanted = inputs.words(spark, d).select(F.upper("word").alias("word"))
    found = lookup.find_words(inputs.cased_words(spark, d), wanted, case_sensitive=True)
    return found.select("query", "index", "word", r6(F.col("vector")[0], "first"))


def missing_words(spark, d):
    return lookup.missing_words(inputs.words(spark, d), analogy.problem_words(inputs.problems(spark, d)))


def search_whole_word(spark, d):
    return lookup.search(inputs.cased_words(spark, d), "w12")


def search_substring(spark, d):
    return lookup.search(inputs.cased_words(spark, d), "W1", substring=True)


def search_substring_case_sensitive(spark, d):
    return lookup.search(inputs.cased_words(spark, d), "W1", substring=True, case_sensitive=True)


# Nearest rows


def _nearest_to_word(spark, d, metric):
    df = inputs.stretched_words(spark, d)
    query = lookup.find_word(df, "w7").head()["vector"]
    return nearest.find_nearest(df, query, 10, metric).select("index", "word", r6("score"))


def nearest_cosine(spark, d):
    return _nearest_to_word(spark, d, "cosine")


def nearest_euclidean(spark, d):
    return _nearest_to_word(spark, d, "euclidean")


def nearest_by_city_blocks(spark, d):
    """A score of one's own: the sum of the absolute differences."""
    df = inputs.stretched_words(spark, d)
    query = F.array(*[F.lit(x) for x in lookup.find_word(df, "w7").head()["vector"]])
    apart = F.zip_with("vector", query, lambda x, y: F.abs(x - y))
    score = F.aggregate(apart, F.lit(0.0), lambda total, x: total + x)
    return nearest.find_nearest_by(df, score, 10, lower_is_better=True).select("index", "word", r6("score"))


def _nearest_batch(spark, d, n):
    df = inputs.stretched_words(spark, d)
    found = nearest.find_nearest_multi(df, inputs.neighbour_sums(df), n, ["euclidean", "cosine"])
    return found.select("qid", "metric", "rank", "index", "word", r6("score"))


def nearest_one_batch(spark, d):
    return _nearest_batch(spark, d, 1)


def nearest_many_batch(spark, d):
    return _nearest_batch(spark, d, 5)


# Copies of less than this go to the tasks in the queries that show what happens when neither side is small.
SMALL_BYTES = 256 * 1024


def nearest_in_cells(spark, d):
    """As ``nearest_many_batch``, both sides being too large to copy."""
    df = inputs.stretched_words(spark, d)
    found = nearest.find_nearest_multi(df, inputs.neighbour_sums(df), 5, ["euclidean", "cosine"], broadcast_bytes=SMALL_BYTES)
    return found.select("qid", "metric", "rank", "index", "word", r6("score"))


def nearest_batch_of_unit_vectors(spark, d):
    stretched = inputs.stretched_words(spark, d)
    queries = inputs.neighbour_sums(stretched)
    found = nearest.find_nearest_multi(V.to_unit_vectors(stretched), queries, 3, "normalized_cosine")
    return found.select("qid", "rank", "index", r6("score"))


def top_lines_per_flag(spark, d):
    lines = inputs.table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return topn.top_n_per_group(lines, ["l_returnflag"], order, 10)


def top_lines_of_many(spark, d):
    """More rows per group than Spark limits partitions to by itself."""
    lines = inputs.table(spark, d, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return topn.top_n_per_group(lines, ["l_linestatus"], order, 5000)


def best_event_per_type(spark, d):
    events = inputs.table(spark, d, "events").select("event_type", "event_id", "value")
    return topn.top_n_per_group(events, ["event_type"], [F.desc("value"), F.asc("event_id")], 1)


# Statistics


def model_shape(spark, d):
    return stats.model_shape(inputs.words(spark, d))


def price_summary(spark, d):
    found = stats.summary(inputs.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice") / 1000)
    return found.select("l_returnflag", "l_linestatus", "n", *rounded(*NUMBERS))


def event_summary(spark, d):
    return stats.summary(inputs.table(spark, d, "events"), ["event_type"], "value").select("event_type", "n", *rounded(*NUMBERS))


def event_percentiles(spark, d):
    found = stats.exact_percentiles(inputs.table(spark, d, "events"), ["event_type"], "value", (0.5, 10, 50, 99.9))
    return found.select("event_type", "n", *rounded("p0_5", "p10", "p50", "p99_9"))


def price_percentiles(spark, d):
    return stats.exact_percentiles(inputs.table(spark, d, "lineitem"), [], "l_extendedprice").select("n", *rounded(*POINTS))


def price_histogram(spark, d):
    found = stats.histogram(inputs.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 25)
    return found.select("l_returnflag", "bin", *rounded("low", "high"), "count")


def event_histogram(spark, d):
    return stats.histogram(inputs.table(spark, d, "events"), [], "value", 10).select("bin", *rounded("low", "high"), "count")


def dimension_statistics(spark, d):
    return stats.dimension_stats(inputs.words(spark, d)).select("dimension", "n", *rounded(*NUMBERS))


def dimension_histograms(spark, d):
    found = stats.dimension_stats(inputs.words(spark, d))
    return found.select("dimension", F.posexplode("histogram").alias("bin", "count"))


def norm_statistics(spark, d):
    return stats.norm_stats(inputs.stretched_words(spark, d)).select("n", *rounded(*NUMBERS))


def _models(spark, d):
    stretched = inputs.stretched_words(spark, d)
    return {"stretched": stretched, "stretched-normalized": V.to_unit_vectors(stretched)}


def analyze_models(spark, d):
    found = stats.analyze(_models(spark, d)).withColumn("dimension", F.coalesce("dimension", F.lit(-1)))
    return found.select("model", "words", "dimensionality", "dimension", "n", *rounded(*NUMBERS))


def outlier_ranges(spark, d):
    found = stats.dimension_stats(inputs.words(spark, d))
    for rule in stats.OUTLIER_RULES:
        found = stats.outlier_bounds(found, rule).withColumnsRenamed({"range_low": f"{rule}_low", "range_high": f"{rule}_high"})
    return found.select("dimension", *rounded(*[f"{rule}_{end}" for rule in stats.OUTLIER_RULES for end in ("low", "high")]))


def quartiles(spark, d):
    found = stats.quartiles_exclusive(inputs.table(spark, d, "events"), ["event_type"], "value")
    return found.select("event_type", "n", *rounded("q1", "median", "q3"))


# Analogies


def problem_words(spark, d):
    return analogy.problem_words(inputs.problems(spark, d))


def unsolvable_problems(spark, d):
    return analogy.unsolvable_problems(inputs.words(spark, d), inputs.problems(spark, d)).select("problem_id", "category")


def normalized_path(spark, d):
    tables_ = {"stored": inputs.words(spark, d), **_models(spark, d)}
    rows = [(name, analogy.use_normalized_path(df)) for name, df in tables_.items()]
    return spark.createDataFrame(rows, "model string, normalized boolean")


def _answers(results):
    return results.select("problem_id", "category", "metric", "word", r6("score"), "solved", "correct")


def solve_analogies(spark, d):
    return _answers(analogy.solve_analogies(inputs.stretched_words(spark, d), inputs.problems(spark, d)))


def solve_analogies_normalized(spark, d):
    df = V.to_unit_vectors(inputs.words(spark, d))
    return _answers(analogy.solve_analogies(df, inputs.problems(spark, d), normalized=True))


def solve_analogies_without_inputs(spark, d):
    return _answers(analogy.solve_analogies(inputs.words(spark, d), inputs.problems(spark, d), exclude_inputs=True))


def _performance(found, *keys):
    return found.select(*keys, "metric", "side", "test_count", "n", *rounded("accuracy", *NUMBERS))


def evaluate_models(spark, d):
    performance, _ = analogy.evaluate(_models(spark, d), inputs.problems(spark, d), normalized=True)
    return _performance(performance, "model", "category")


def analogy_score_histograms(spark, d):
    results = analogy.settled(analogy.solve_analogies(inputs.stretched_words(spark, d), inputs.problems(spark, d)))
    found = analogy.algorithm_performance(results)
    return found.select("category", "metric", "side", F.posexplode("histogram").alias("bin", "count"))


def incorrect_analogies(spark, d):
    results = analogy.settled(analogy.solve_analogies(inputs.stretched_words(spark, d), inputs.problems(spark, d)))
    return analogy.incorrect_results(results).select(
        "category", "problem_id", "a", "b", "c", "d", "euclidean_word", r6("euclidean_score"), "cosine_word", r6("cosine_score")
    )


# Clusters


def assign_clusters(spark, d):
    found = clustering.assign_clusters(inputs.stretched_words(spark, d), inputs.label_centroids(spark, d))
    return found.select("index", "word", "cluster", r6("sq_distance"))


def assign_to_many_clusters(spark, d):
    """Every row's vector is a centre, too many of them to copy to the tasks."""
    centres = inputs.words(spark, d).select(F.col("index").cast("int").alias("cluster"), F.col("vector").alias("center"))
    found = clustering.assign_clusters(inputs.stretched_words(spark, d), centres, broadcast_bytes=SMALL_BYTES)
    return found.select("index", "word", "cluster", r6("sq_distance"))


def wsse(spark, d):
    return clustering.wsse(inputs.stretched_words(spark, d), inputs.label_centroids(spark, d)).select(r6("wsse"))


def cluster_quality(spark, d):
    found = clustering.cluster_quality(inputs.stretched_words(spark, d), inputs.label_centroids(spark, d))
    return found.select("k", *rounded("wsse", "mean_distance_to_centroid", "mean_cosine_distance"))


def _center_elements(centroids, *keys):
    rows = centroids.select(*keys, "cluster", F.posexplode("center").alias("pos", "x"))
    return rows.select(*keys, "cluster", "pos", r6("x", "value"))


def lloyd_step(spark, d):
    return _center_elements(clustering.lloyd_step(inputs.words(spark, d), inputs.label_centroids(spark, d)))


def kmeans_warm_start(spark, d):
    trained = clustering.kmeans_warm_start(inputs.words(spark, d), inputs.label_centroids(spark, d), 3, tolerance=0.0)
    return _center_elements(trained)


def kmeans_bounded(spark, d):
    """The warm start by steps that compare only rows whose cluster may have changed."""
    trained, _ = bounded.kmeans_with_bounds(inputs.words(spark, d), inputs.label_centroids(spark, d), 3, tolerance=0.0, groups=3)
    return _center_elements(trained)


def kmeans_in_steps(spark, d):
    """Resumes from a stored state, stores each step and reads the states back."""
    path, k = scratch(spark, "states"), 10
    tables.save_centroids(inputs.label_centroids(spark, d), path, "words", k, 1, 2)
    done = clustering.kmeans_in_steps(
        inputs.words(spark, d),
        k,
        total_iterations=6,
        iterations_per_step=2,
        resume=(2, tables.load_centroids(spark, path, "words", k, 1, 2)),
        on_step=lambda iteration, centroids: tables.save_centroids(centroids, path, "words", k, 1, iteration),
    )
    found = None
    for iteration, _ in done:
        state = tables.load_centroids(spark, path, "words", k, 1, iteration).withColumn("iteration", F.lit(iteration))
        found = state if found is None else found.unionByName(state)
    return _center_elements(found, "iteration")


def kmeans_train(spark, d):
    trained = clustering.kmeans_train(inputs.words(spark, d), k=10, iterations=5, runs=2, seed=42, tolerance=0.0)
    found = clustering.cluster_quality(inputs.words(spark, d), trained, iterations=5, runs=2)
    return found.select("k", "iterations", "runs", *rounded("wsse", "mean_distance_to_centroid", "mean_cosine_distance"))


def kmeans_trained_centers(spark, d):
    return _center_elements(clustering.kmeans_train(inputs.words(spark, d), k=7, iterations=4, runs=3, seed=1, tolerance=0.0))


def cluster_members(spark, d):
    found = clustering.cluster_members(inputs.words(spark, d), inputs.label_centroids(spark, d))
    return found.select("cluster", "representative_index", "representative", "index", "word", r6("sq_distance"))


def cluster_lines(spark, d):
    return clustering.cluster_lines(inputs.words(spark, d), inputs.label_centroids(spark, d), line_members=20)


# Sources and sinks


def text_vectors(spark, d):
    """Stored as text lines in order of index, read back with the index taken from the file order."""
    path = scratch(spark, "text")
    lines = inputs.words(spark, d).orderBy("index").select(F.concat_ws(" ", "word", F.col("vector").cast("array<string>")))
    lines.write.text(path)
    return elements(text.read_text_vectors(spark, path), "index", "word")


def binary_vectors(spark, d):
    """Stored in the binary form and read back, each file with its own index from 0."""
    found = None
    for number, path in inputs.binary_files(inputs.words(spark, d), scratch(spark, "binary")):
        rows = binary.read_binary_vectors(spark, path, split_bytes=32 * 1024 * 1024).withColumn("file", F.lit(number).cast("long"))
        found = rows if found is None else found.unionByName(rows)
    return elements(found, "file", "index", "word")


def loaded_models(spark, d):
    """Text lines loaded into a raw and a unit-length model, both read back."""
    path, out = scratch(spark, "input.txt"), scratch(spark, "models")
    stretched = inputs.stretched_words(spark, d).orderBy("index")
    stretched.select(F.concat_ws(" ", "word", F.col("vector").cast("array<string>"))).write.text(path)
    ((raw, unit),) = tables.load_model(spark, [path], "text", out).values()
    stored = {"raw": raw, "normalized": unit}
    both = tables.union_models({kind: tables.read_vectors(spark, where) for kind, where in stored.items()})
    return elements(both, "model", "index", "word")


def stored_vectors(spark, d):
    path = scratch(spark, "vectors")
    tables.write_vectors(inputs.words(spark, d), path)
    return elements(tables.read_vectors(spark, path), "index", "word")


def vector_lines(spark, d):
    short = F.transform("vector", lambda x: F.round(x, 3).cast("decimal(10,3)"))
    lines = tables.vector_lines(inputs.words(spark, d).withColumn("vector", short))
    path = scratch(spark, "lines")
    lines.write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def analogy_files(spark, d):
    """One file per category, read back with the category taken from the file name."""
    path = scratch(spark, "problems")
    asked = inputs.problems(spark, d).select("category", "problem_id", F.concat_ws(" ", "a", "b", "c", "d").alias("line"))
    in_order = asked.repartition("category").sortWithinPartitions("category", "problem_id").drop("problem_id")
    in_order.write.partitionBy("category").text(path)
    # The writer names files itself; a category's one file takes its name.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.Path(f"{path}/named"))
    for found in files.globStatus(hadoop.Path(f"{path}/category=*/part-*")):
        category = found.getPath().getParent().getName().removeprefix("category=")
        files.rename(found.getPath(), hadoop.Path(f"{path}/named/{category}"))
    return analogies.read_analogies(spark, f"{path}/named")


def statistics_report(spark, d):
    path = scratch(spark, "report")
    tables.write_report(tables.statistics_report(stats.analyze(_models(spark, d))), path)
    stored = spark.read.json(path)
    rows = stored.select("model", "words", "dimensionality", F.posexplode("dimension_stats").alias("dimension", "s"))
    return rows.select(
        "model", "words", "dimensionality", "dimension", r6("s.mean", "mean"), r6(F.col("s.percentiles")["50"], "median")
    )


def _reported(spark, models):
    """Every model's statistics as stored in a report, one row per dimension and one for the lengths."""
    path = scratch(spark, "report")
    tables.write_report(tables.statistics_report(stats.analyze(models)), path)
    stored = spark.read.json(path)
    every = F.concat("dimension_stats", F.array("norm_stats"))
    rows = stored.select("model", F.size("dimension_stats").alias("held"), F.posexplode(every).alias("at", "s"))
    return rows.withColumn("dimension", F.when(F.col("at") < F.col("held"), F.col("at")).otherwise(-1))


def reported_numbers(spark, d):
    points = [r6(F.col("s.percentiles")[str(p)], f"p{p}") for p in stats.PERCENTILES]
    numbers = [r6(f"s.{name}", name) for name in ("max", "min", "mean", "stdev", "variance")]
    return _reported(spark, _models(spark, d)).select("model", "dimension", *numbers, *points)


def reported_histograms(spark, d):
    # The lengths of unit vectors differ by rounding alone, so their bins say nothing; two models of other lengths are shown.
    models = {"stored": inputs.words(spark, d), "stretched": inputs.stretched_words(spark, d)}
    return _reported(spark, models).select("model", "dimension", F.posexplode("s.histogram").alias("bin", "count"))


def evaluation_misses(spark, d):
    """The problems that either metric answered wrongly, for every model."""
    _, misses = analogy.evaluate(_models(spark, d), inputs.problems(spark, d), normalized=True)
    answers = ["euclidean_word", r6("euclidean_score"), "euclidean_correct", "cosine_word", r6("cosine_score"), "cosine_correct"]
    return misses.select("model", "category", "problem_id", "a", "b", "c", "d", *answers)


def evaluation_report(spark, d):
    path = scratch(spark, "report")
    performance, _ = analogy.evaluate({"stretched": inputs.stretched_words(spark, d)}, inputs.problems(spark, d))
    tables.write_report(tables.evaluation_report(performance), path)
    return spark.read.json(path).select(
        "model",
        "category",
        "test_count",
        r6("euclidean_performance.accuracy", "euclidean_accuracy"),
        r6("cosine_performance.accuracy", "cosine_accuracy"),
        r6("euclidean_performance.stats.mean", "euclidean_mean"),
        r6("cosine_performance.incorrect_stats.max", "cosine_incorrect_max"),
    )


def stored_centroids(spark, d):
    path = scratch(spark, "centroids")
    tables.save_centroids(inputs.label_centroids(spark, d), path, "words", 10, 1, 0)
    return _center_elements(tables.load_centroids(spark, path, "words", 10, 1, 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        vector_sum,
        vector_difference,
        pair_scores,
        normalized_cosine,
        vector_norm,
        normalized_check,
        unit_vectors,
        analogy_query_vectors,
        find_all_words,
        find_first_words,
        find_word,
        find_words,
        find_words_case_sensitive,
        missing_words,
        search_whole_word,
        search_substring,
        search_substring_case_sensitive,
        nearest_cosine,
        nearest_euclidean,
        nearest_by_city_blocks,
        nearest_one_batch,
        nearest_many_batch,
        nearest_in_cells,
        nearest_batch_of_unit_vectors,
        top_lines_per_flag,
        top_lines_of_many,
        best_event_per_type,
        model_shape,
        price_summary,
        event_summary,
        event_percentiles,
        price_percentiles,
        price_histogram,
        event_histogram,
        dimension_statistics,
        dimension_histograms,
        norm_statistics,
        analyze_models,
        outlier_ranges,
        quartiles,
        problem_words,
        unsolvable_problems,
        normalized_path,
        solve_analogies,
        solve_analogies_normalized,
        solve_analogies_without_inputs,
        evaluate_models,
        evaluation_misses,
        analogy_score_histograms,
        incorrect_analogies,
        assign_clusters,
        assign_to_many_clusters,
        wsse,
        cluster_quality,
        lloyd_step,
        kmeans_warm_start,
        kmeans_bounded,
        kmeans_in_steps,
        kmeans_train,
        kmeans_trained_centers,
        cluster_members,
        cluster_lines,
        text_vectors,
        binary_vectors,
        loaded_models,
        stored_vectors,
        vector_lines,
        analogy_files,
        statistics_report,
        reported_numbers,
        reported_histograms,
        evaluation_report,
        stored_centroids,
    )
}
