"""K-means over the word table. A centroid table has ``cluster int, center array<double>``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from wordloom.bounds import BROADCAST_BYTES, settled, small_or_settled
from wordloom.functions.vectors import cosine_similarity, euclidean
from wordloom.operators.kernels import lengths, list_column, matrix, nearest_centre
from wordloom.operators.nearest import collected_within, find_nearest_multi, vector_size
from wordloom.prefix import running_totals

# Cluster members on one text line; further ones follow on further lines.
LINE_MEMBERS = 10_000
# Parts in which the sums of one cluster are added before they meet, and clusters whose sums a task holds at once.
SUM_PARTS = 64
HELD_CLUSTERS = 4096

CENTROIDS = "cluster int, center array<double>"
SUMS = "cluster int, members bigint, sums array<double>"


def _centre_matrix(df: DataFrame, centroids: DataFrame, broadcast_bytes: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Cluster ids in ascending order with their centres, or None when they are too large to copy to every task."""
    named = settled(centroids.select("cluster", F.col("center").alias("vector")))
    table = collected_within(named, broadcast_bytes, vector_size(df))
    if table is None:
        return None
    ids = table.column("cluster").to_numpy()
    order = np.argsort(ids, kind="stable")
    centres = matrix(table.column("vector"))[order] if len(ids) else np.zeros((0, 0))
    return ids[order], centres


def _centroid_table(spark: SparkSession, held: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    ids, centres = held
    return spark.createDataFrame(pa.table({"cluster": pa.array(ids, pa.int32()), "center": list_column(centres)}), CENTROIDS)


def assign_clusters(df: DataFrame, centroids: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``index, word, cluster, sq_distance``: the nearest centre of each row, lowest cluster among equals.

    A row with an element that is not a finite number has no cluster: its cluster and distance are NULL, whichever side
    is copied to the tasks. Rows may share an index.
    """
    return _assigned(df, centroids, broadcast_bytes).select("index", "word", "cluster", "sq_distance")


def _assigned(df: DataFrame, centroids: DataFrame, broadcast_bytes: int) -> DataFrame:
    """The assignment with the cosine distance to the own centre."""
    held = _centre_matrix(df, centroids, broadcast_bytes)
    if held is None:
        return _assigned_by_blocks(df, centroids, broadcast_bytes)
    shared = df.sparkSession.sparkContext.broadcast(held)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centres = shared.value
        centre_norms = lengths(centres)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            vectors, odd = _finite(matrix(batch.column("vector"), centres.shape[1]))
            position, squared = nearest_centre(vectors, centres)
            scale = lengths(vectors) * centre_norms[position]
            dots = (vectors * centres[position]).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = pa.array(1.0 - dots / scale, mask=(scale == 0) | odd)
            cluster = pa.array(ids[position].astype(np.int32), mask=odd)
            yield pa.RecordBatch.from_arrays(
                [batch.column("index"), batch.column("word"), cluster, pa.array(squared, mask=odd), cosine],
                ["index", "word", "cluster", "sq_distance", "cosine_distance"],
            )

    return df.select("index", "word", "vector").mapInArrow(
        assign, "index long, word string, cluster int, sq_distance double, cosine_distance double"
    )


def _finite(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors with zeros in place of rows that hold an element that is no finite number, and which rows these are."""
    odd = ~np.isfinite(vectors).all(axis=1)
    if odd.any():
        vectors = vectors.copy()
        vectors[odd] = 0.0
    return vectors, odd


def _assigned_by_blocks(df: DataFrame, centroids: DataFrame, broadcast_bytes: int, keep_vector: bool = False) -> DataFrame:
    centres = centroids.select(
        F.col("cluster").cast("long").alias("index"), F.lit("").alias("word"), F.col("center").alias("vector")
    )
    # The row's own id ties the answer to it, as an index may be shared.
    rows = settled(df.select("index", "word", "vector").withColumn("row_id", F.monotonically_increasing_id()))
    number = ~F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    queries = rows.filter(number).select(F.col("row_id").alias("qid"), "vector")
    nearest = find_nearest_multi(centres, queries, 1, "squared_euclidean", broadcast_bytes).select(
        F.col("qid").alias("row_id"), F.col("index").cast("int").alias("cluster"), F.col("score").alias("sq_distance")
    )
    own = rows.join(nearest, "row_id", "left").join(centroids, "cluster", "left")
    kept = ["vector"] if keep_vector else []
    distance = (1.0 - cosine_similarity("vector", "center")).alias("cosine_distance")
    return own.select("index", "word", "cluster", "sq_distance", distance, *kept)


def wsse(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """Sum of squared distances to the nearest centre."""
    return assign_clusters(df, centroids).agg(F.sum("sq_distance").alias("wsse"))


def cluster_quality(
    df: DataFrame, centroids: DataFrame, k: int | None = None, iterations: int | None = None, runs: int | None = None
) -> DataFrame:
    """One row: ``k, iterations, runs, wsse, mean_distance_to_centroid, mean_cosine_distance``."""
    measures = _assigned(df, centroids, BROADCAST_BYTES).agg(
        F.sum("sq_distance").alias("wsse"),
        F.avg(F.sqrt("sq_distance")).alias("mean_distance_to_centroid"),
        F.avg("cosine_distance").alias("mean_cosine_distance"),
    )
    count = centroids.count() if k is None else k
    return measures.select(
        F.lit(count).cast("int").alias("k"), F.lit(iterations).cast("int").alias("iterations"), F.lit(runs).cast("int").alias("runs"), "*"
    )


def lloyd_step(df: DataFrame, centroids: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The centroid table after one iteration: each centre becomes the mean of its rows; an empty cluster keeps its centre.

    Each task sums its own rows per cluster, so only one row per cluster and task is shuffled however large a cluster is.
    Rows without a cluster change no centre.
    """
    held = _centre_matrix(df, centroids, broadcast_bytes)
    if held is not None:
        means = _means(_partial_sums(df, held))
        centroids = _centroid_table(df.sparkSession, held)
    else:
        assigned = _assigned_by_blocks(df, centroids, broadcast_bytes, keep_vector=True).filter("cluster is not null")
        means = _means(assigned.select("cluster", "vector").mapInArrow(_sums_per_task, SUMS))
    return centroids.join(means, "cluster", "left").select("cluster", F.coalesce("mean", "center").alias("center"))


def _sums_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members and sums of vectors per cluster, given out when the task holds those of many clusters."""
    sums: dict[int, np.ndarray] = {}
    members: dict[int, int] = {}

    def given() -> pa.RecordBatch:
        out = _sum_rows(np.array(list(sums), np.int32), np.array([members[c] for c in sums], np.int64), np.stack(list(sums.values())))
        sums.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        vectors, clusters = matrix(batch.column("vector")), batch.column("cluster").to_numpy()
        order = np.argsort(clusters, kind="stable")
        present, starts = np.unique(clusters[order], return_index=True)
        added = np.add.reduceat(vectors[order], starts, axis=0)
        for c, n, v in zip(present.tolist(), np.diff(np.append(starts, len(order))).tolist(), added):
            members[c] = members[c] + n if c in sums else n
            sums[c] = sums[c] + v if c in sums else v
        if len(sums) > HELD_CLUSTERS:
            yield given()
    if sums:
        yield given()


def _sum_rows(clusters: np.ndarray, members: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(clusters, pa.int32()), pa.array(members), list_column(sums)], ["cluster", "members", "sums"])


def _means(sums: DataFrame) -> DataFrame:
    """``cluster, mean`` from sums of vectors and the counts behind them.

    The arrays are shuffled as they are and added in two steps, first in parts of a cluster, then the parts.
    """

    def add(table: pa.Table) -> pa.Table:
        total = matrix(table.column("sums")).sum(axis=0, keepdims=True)
        members = np.array([table.column("members").to_numpy().sum()], np.int64)
        return pa.Table.from_batches([_sum_rows(np.array([table.column("cluster")[0].as_py()], np.int32), members, total)])

    def divide(table: pa.Table) -> pa.Table:
        total = add(table)
        mean = matrix(total.column("sums")) / total.column("members").to_numpy()[:, None]
        return pa.table({"cluster": total.column("cluster"), "mean": list_column(mean)})

    parts = sums.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SUM_PARTS)))
    added = parts.groupBy("cluster", "part").applyInArrow(add, SUMS)
    return added.groupBy("cluster").applyInArrow(divide, "cluster int, mean array<double>")


def _partial_sums(df: DataFrame, held: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centres = shared.value
        sums, members = np.zeros_like(centres), np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            vectors, odd = _finite(matrix(batch.column("vector"), centres.shape[1]))
            vectors = vectors[~odd]
            if not len(vectors):
                continue
            position, _ = nearest_centre(vectors, centres)
            order = np.argsort(position, kind="stable")
            present, starts = np.unique(position[order], return_index=True)
            sums[present] += np.add.reduceat(vectors[order], starts, axis=0)
            members += np.bincount(position, minlength=len(ids))
        used = np.flatnonzero(members)
        if len(used):
            yield _sum_rows(ids[used], members[used], sums[used])

    return df.select("vector").mapInArrow(total, SUMS)


def random_starts(df: DataFrame, k: int, runs: int, seed: int = 0) -> np.ndarray:
    """``runs`` x ``k`` x dimensions start centres: the rows in order of the md5 of seed and index, dealt out in turn.

    The order depends on the ids alone, so every rerun and every partitioning starts alike. Rows that hold an element
    that is no finite number are no starts; when there are fewer than ``runs * k`` rows, later runs begin again.
    """
    number = ~F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("index").cast("string")))
    # Only ids are sorted; the chosen rows are then read with their vectors.
    ids = df.filter(number).select("index", order.alias("order")).orderBy("order", "index").limit(runs * k)
    chosen = df.filter(number).join(F.broadcast(ids), "index").orderBy("order", "index").limit(runs * k).select("vector").toArrow()
    starts = matrix(chosen.column("vector")) if chosen.num_rows else np.zeros((0, 0))
    if not len(starts):
        return np.zeros((runs, 0, 0))
    held = min(k, len(starts))
    return starts[np.arange(runs * held) % len(starts)].reshape(runs, held, -1)


def _run_sums(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """Members and sums of vectors of every cluster of every run from one pass, cluster c of run r being r * k + c."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, k, dimensions = shared.value.shape
        sums, members = np.zeros((runs * k, dimensions)), np.zeros(runs * k, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, odd = _finite(matrix(batch.column("vector"), dimensions))
            vectors = vectors[~odd]
            if not len(vectors):
                continue
            for run, own in enumerate(shared.value):
                position = nearest_centre(vectors, own)[0] + run * k
                order = np.argsort(position, kind="stable")
                present, starts = np.unique(position[order], return_index=True)
                sums[present] += np.add.reduceat(vectors[order], starts, axis=0)
                members += np.bincount(position, minlength=len(members))
        used = np.flatnonzero(members)
        if len(used):
            yield _sum_rows(used.astype(np.int32), members[used], sums[used])

    return points.mapInArrow(total, SUMS)


def _run_costs(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Sum of squared distances to the nearest centre of every run, from one pass."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = np.zeros(len(shared.value))
        for batch in batches:
            if batch.num_rows:
                vectors, odd = _finite(matrix(batch.column("vector"), shared.value.shape[2]))
                vectors = vectors[~odd]
                costs += [nearest_centre(vectors, own)[1].sum() if len(vectors) else 0.0 for own in shared.value]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(costs)), pa.int32()), pa.array(costs)], ["run", "cost"])

    summed = points.mapInArrow(total, "run int, cost double").groupBy("run").agg(F.sum("cost").alias("cost")).collect()
    return np.array([r["cost"] for r in sorted(summed)])


def train_runs(
    df: DataFrame, starts: np.ndarray, iterations: int, tolerance: float = 1e-4, broadcast_bytes: int = BROADCAST_BYTES
) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd steps for several runs side by side: the centres of every run and its cost.

    Each step is one pass over the rows for all runs, as long as the runs' centres fit in ``broadcast_bytes``; otherwise
    as many runs as fit go together. A run none of whose centres moved by more than ``tolerance`` stands still and is left out
    of later steps.
    """
    together = max(1, broadcast_bytes // max(1, starts[0].nbytes))
    if len(starts) > together:
        parts = [train_runs(df, starts[i : i + together], iterations, tolerance, broadcast_bytes) for i in range(0, len(starts), together)]
        return np.concatenate([c for c, _ in parts]), np.concatenate([cost for _, cost in parts])
    points, centres = df.select("vector").persist(StorageLevel.MEMORY_AND_DISK), starts.copy()
    k, moving = centres.shape[1], np.arange(len(centres))
    try:
        for _ in range(iterations):
            if not len(moving):
                break
            means = _means(_run_sums(points, centres[moving])).toArrow()
            moved = centres[moving].reshape(len(moving) * k, -1)
            if means.num_rows:
                moved[means.column("cluster").to_numpy()] = matrix(means.column("mean"), moved.shape[1])
            moved = moved.reshape(len(moving), k, -1)
            shifts = np.sqrt(((moved - centres[moving]) ** 2).sum(axis=2)).max(axis=1)
            centres[moving] = moved
            moving = moving[shifts > tolerance]
        return centres, _run_costs(points, centres)
    finally:
        points.unpersist()


def kmeans_train(
    df: DataFrame, k: int, iterations: int, runs: int = 1, seed: int = 0, tolerance: float = 1e-4, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Train from random rows; of ``runs`` starts the one with the lowest cost wins, the first among equals.

    The number of passes over the rows does not grow with ``runs`` while their centres fit in ``broadcast_bytes`` together.
    When not even one run's centres fit, they stay a table and the runs follow one another.
    """
    if runs < 1:
        raise ValueError("runs must be at least 1")
    if 8 * k * max(1, vector_size(df)) > broadcast_bytes:
        return _train_by_blocks(df, k, iterations, runs, seed, tolerance)
    starts = random_starts(df, k, runs, seed)
    if not starts.shape[1]:
        return df.sparkSession.createDataFrame([], CENTROIDS)
    centres, costs = train_runs(df, starts, iterations, tolerance, broadcast_bytes)
    best = centres[int(costs.argmin())]
    return _centroid_table(df.sparkSession, (np.arange(len(best)), best))


def _train_by_blocks(df: DataFrame, k: int, iterations: int, runs: int, seed: int, tolerance: float) -> DataFrame:
    number = ~F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("index").cast("string")))
    one = F.lit(1).cast("long").alias("one")
    placed = running_totals(df.filter(number).select("index", order.alias("order"), one), [], ["order", "index"], "one", "place")
    chosen = placed.filter(F.col("place") < k * runs).select("index", "place")
    starts = settled(df.join(chosen, "index").select("place", F.col("vector").alias("center")))
    best = None
    for run in range(runs):
        own = starts.filter(F.floor(F.col("place") / k) == run).select((F.col("place") % k).cast("int").alias("cluster"), "center")
        trained = _warm_start_by_blocks(df, own, iterations, tolerance)
        cost = wsse(df, trained).head()["wsse"]
        if cost is not None and (best is None or cost < best[0]):
            best = cost, trained
    return best[1] if best is not None else df.sparkSession.createDataFrame([], CENTROIDS)


def kmeans_warm_start(df: DataFrame, centroids: DataFrame, iterations: int, tolerance: float = 1e-4) -> DataFrame:
    """Continue from given centres for ``iterations`` steps, or until no centre moves by more than ``tolerance``."""
    held = _centre_matrix(df, centroids, BROADCAST_BYTES)
    if held is None:
        return _warm_start_by_blocks(df, centroids, iterations, tolerance)
    ids, centres = held
    points = df.select("vector").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(iterations):
            means = _means(_partial_sums(points, (ids, centres))).toArrow()
            moved = centres.copy()
            if means.num_rows:
                moved[np.searchsorted(ids, means.column("cluster").to_numpy())] = matrix(means.column("mean"), centres.shape[1])
            shift = lengths(moved - centres).max(initial=0.0)
            centres = moved
            if shift <= tolerance:
                break
    finally:
        points.unpersist()
    return _centroid_table(df.sparkSession, (ids, centres))


def _warm_start_by_blocks(df: DataFrame, centroids: DataFrame, iterations: int, tolerance: float) -> DataFrame:
    current = settled(centroids.select("cluster", "center"))
    for _ in range(iterations):
        moved = settled(lloyd_step(df, current))
        both = moved.join(current.withColumnRenamed("center", "before"), "cluster")
        shift = both.agg(F.max(euclidean("center", "before")).alias("shift")).head()["shift"]
        current = moved
        if shift is None or shift <= tolerance:
            break
    return current


def train(df: DataFrame, k: int, iterations: int, runs: int | None = None, model: DataFrame | None = None) -> DataFrame:
    """Train afresh from ``runs`` random starts or continue from ``model``; exactly one of the two must be given."""
    if (runs is None) == (model is None):
        raise ValueError("give either runs or model")
    return kmeans_train(df, k, iterations, runs) if model is None else kmeans_warm_start(df, model, iterations)


def kmeans_in_steps(
    df: DataFrame,
    k: int,
    total_iterations: int,
    iterations_per_step: int,
    runs: int = 1,
    resume: tuple[int, DataFrame] | None = None,
    on_step: Callable[[int, DataFrame], None] | None = None,
) -> list[tuple[int, DataFrame]]:
    """Train in steps, calling ``on_step(iteration, centroids)`` after each; ``resume`` is such a pair to go on from."""
    if iterations_per_step < 1 or total_iterations % iterations_per_step:
        raise ValueError("total_iterations must be a multiple of iterations_per_step")
    done, model = resume if resume is not None else (0, None)
    states = []
    for iteration in range(done + iterations_per_step, total_iterations + 1, iterations_per_step):
        model = train(df, k, iterations_per_step, runs if model is None else None, model)
        if on_step is not None:
            on_step(iteration, model)
        states.append((iteration, model))
    return states


def iterations_per_checkpoint(iterations: int, checkpoints: int) -> int:
    """Step size for a number of checkpoints, which must not exceed the number of iterations."""
    if checkpoints < 1 or iterations < checkpoints:
        raise ValueError("the number of checkpoints must be between 1 and the number of iterations")
    return iterations // checkpoints


def cluster_members(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row per word: ``cluster, representative_index, representative, index, word, sq_distance``.

    The representative is the member of lowest index. Empty clusters do not occur.
    """
    assigned = settled(assign_clusters(df, centroids).filter("cluster is not null"))
    return assigned.join(_representatives(assigned), "cluster").select(
        "cluster", "representative_index", "representative", "index", "word", "sq_distance"
    )


def _representatives(assigned: DataFrame) -> DataFrame:
    """``cluster, representative_index, representative, members``; the word is fetched for the index already chosen."""
    first = small_or_settled(
        assigned.groupBy("cluster").agg(F.min("index").alias("representative_index"), F.count(F.lit(1)).alias("members"))
    )
    words = assigned.select("cluster", F.col("index").alias("representative_index"), F.col("word").alias("representative"))
    return small_or_settled(words.join(first, ["cluster", "representative_index"]))


def cluster_lines(df: DataFrame, centroids: DataFrame, line_members: int = LINE_MEMBERS) -> DataFrame:
    """One line ``index:word,index:word,...`` per cluster: ``representative_index, part, line``.

    Members are in order of index, then word; every ``line_members`` of them make a line, parts being numbered from 0. The
    places of the members come from totals over ranges, so a cluster with a third of all words is cut by many tasks.
    """
    assigned = settled(assign_clusters(df, centroids).filter("cluster is not null"))
    ones = assigned.select("cluster", "index", "word", F.lit(1).cast("long").alias("one"))
    placed = running_totals(ones, ["cluster"], ["index", "word"], "one", "before")
    joined = placed.join(_representatives(assigned).select("cluster", "representative_index"), "cluster")
    parts = joined.withColumn("part", F.floor(F.col("before") / line_members).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct("index", "word")))
    text = F.transform(ordered, lambda m: F.concat(m["index"].cast("string"), F.lit(":"), m["word"]))
    return (
        parts.groupBy("representative_index", "cluster", "part")
        .agg(F.array_join(text, ",").alias("line"))
        .select("representative_index", "part", "line")
    )
