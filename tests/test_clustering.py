import hashlib

import numpy as np
import pytest

from wordloom.operators import clustering
from wordloom.sources import tables


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    means = rng.normal(size=(4, 5)) * 6
    return np.concatenate([m + rng.normal(size=(n, 5)) for m, n in zip(means, (200, 40, 30, 30))])


@pytest.fixture(scope="module")
def words(spark, vectors):
    rows = [(i, f"w{i}", v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "index long, word string, vector array<double>").repartition(3)


def table(spark, centres, ids=None):
    ids = range(len(centres)) if ids is None else ids
    return spark.createDataFrame([(int(i), c.tolist()) for i, c in zip(ids, centres)], clustering.CENTROIDS)


def distances(vectors, centres):
    return ((vectors[:, None, :] - centres[None]) ** 2).sum(axis=2)


def matrix_of(centroids):
    return np.array([r["center"] for r in centroids.orderBy("cluster").collect()])


@pytest.mark.parametrize("broadcast_bytes", [clustering.BROADCAST_BYTES, 4 * 104])
def test_assign(spark, words, vectors, broadcast_bytes):
    centres = vectors[[7, 210, 250, 290, 3]]
    ids = [40, 10, 30, 20, 50]
    found = clustering.assign_clusters(words, table(spark, centres, ids), broadcast_bytes).collect()
    squares = distances(vectors, centres)
    for r in found:
        assert r["cluster"] == ids[squares[r["index"]].argmin()]
        assert r["sq_distance"] == pytest.approx(squares[r["index"]].min())
    assert len(found) == len(vectors)


def test_ties_go_to_the_lowest_cluster(spark):
    df = spark.createDataFrame([(0, "a", [0.0, 0.0]), (1, "b", [5.0, 1.0])], "index long, word string, vector array<double>")
    centres = np.array([[3.0, 4.0], [4.0, 3.0], [3.0, 4.0], [-5.0, 0.0]])
    found = {r["index"]: r for r in clustering.assign_clusters(df, table(spark, centres, [9, 8, 2, 5])).collect()}
    assert found[0]["cluster"] == 2 and found[0]["sq_distance"] == 25.0
    assert found[1]["cluster"] == 8


def test_quality(spark, words, vectors):
    centres = vectors[[7, 210, 250]]
    squares = distances(vectors, centres)
    own = centres[squares.argmin(axis=1)]
    cosine = 1 - (own * vectors).sum(axis=1) / np.linalg.norm(own, axis=1) / np.linalg.norm(vectors, axis=1)
    row = clustering.cluster_quality(words, table(spark, centres), iterations=5, runs=2).head()
    assert (row["k"], row["iterations"], row["runs"]) == (3, 5, 2)
    assert row["wsse"] == pytest.approx(squares.min(axis=1).sum())
    assert row["mean_distance_to_centroid"] == pytest.approx(np.sqrt(squares.min(axis=1)).mean())
    assert row["mean_cosine_distance"] == pytest.approx(cosine.mean())
    assert clustering.wsse(words, table(spark, centres)).head()["wsse"] == pytest.approx(row["wsse"])


@pytest.mark.parametrize("broadcast_bytes", [clustering.BROADCAST_BYTES, 3 * 104])
def test_lloyd_step_keeps_empty_clusters(spark, words, vectors, broadcast_bytes):
    centres = np.r_[vectors[[7, 210, 250]], np.full((1, 5), 1e6)]
    nearest = distances(vectors, centres).argmin(axis=1)
    expected = [vectors[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(4)]
    assert np.allclose(matrix_of(clustering.lloyd_step(words, table(spark, centres), broadcast_bytes)), expected)


def test_warm_start_lowers_cost_and_stops(spark, words, vectors, monkeypatch):
    start = table(spark, vectors[[0, 1, 2, 3]])
    costs = [clustering.wsse(words, start).head()[0]]
    for steps in (1, 2, 4):
        trained = clustering.kmeans_warm_start(words, start, steps, tolerance=0.0)
        costs.append(clustering.wsse(words, trained).head()[0])
    assert all(after <= before + 1e-9 for before, after in zip(costs, costs[1:]))
    settled = clustering.kmeans_warm_start(words, start, 100)
    again = clustering.kmeans_warm_start(words, settled, 1)
    assert np.allclose(matrix_of(settled), matrix_of(again), atol=1e-3)
    plain = matrix_of(clustering._warm_start_by_blocks(words, start, 2, 0.0))
    assert np.allclose(plain, matrix_of(clustering.kmeans_warm_start(words, start, 2, tolerance=0.0)))


def test_train(spark, words, vectors):
    trained = clustering.kmeans_train(words, k=4, iterations=10, runs=3, seed=1)
    assert [f.name for f in trained.schema] == ["cluster", "center"] and trained.count() == 4
    single = clustering.kmeans_train(words, k=4, iterations=10, runs=1, seed=1)
    assert clustering.wsse(words, trained).head()[0] <= clustering.wsse(words, single).head()[0] + 1e-9
    for wrong in ({}, {"runs": 1, "model": trained}):
        with pytest.raises(ValueError):
            clustering.train(words, 4, 1, **wrong)


def lloyd(vectors, centres, steps):
    for _ in range(steps):
        own = distances(vectors, centres).argmin(axis=1)
        centres = np.array([vectors[own == c].mean(axis=0) if (own == c).any() else centre for c, centre in enumerate(centres)])
    return centres, distances(vectors, centres).min(axis=1).sum()


def test_runs_side_by_side_are_the_runs_one_by_one(spark, words, vectors):
    order = sorted(range(len(vectors)), key=lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i))
    starts = vectors[order[:12]].reshape(3, 4, -1)
    assert np.allclose(clustering.random_starts(words.repartition(5), 4, 3, seed=5), starts)
    want = [lloyd(vectors, start, 3) for start in starts]
    centres, costs = clustering.train_runs(words, starts, 3, tolerance=0.0)
    assert np.allclose(centres, [c for c, _ in want]) and np.allclose(costs, [cost for _, cost in want])
    # One at a time, or as a table too large to copy, they give the same.
    for room in (starts[0].nbytes, 50):
        trained = clustering.kmeans_train(words, 4, 3, runs=3, seed=5, tolerance=0.0, broadcast_bytes=room)
        assert np.allclose(matrix_of(trained), min(want, key=lambda w: w[1])[0])


def test_passes_do_not_grow_with_the_runs(spark, words):
    read = {}
    for runs in (1, 4):
        rows = spark.sparkContext.accumulator(0)

        def count(batches, rows=rows):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        counted = words.mapInArrow(count, words.schema)
        starts = clustering.random_starts(words, 3, runs)
        clustering.train_runs(counted, starts, 3, tolerance=0.0)
        read[runs] = rows.value
    # The rows are kept after the first pass, whatever the number of runs.
    assert read[1] == read[4] == 300


def test_more_clusters_than_distinct_vectors(spark):
    df = spark.createDataFrame([(i, f"w{i}", [float(i % 2)]) for i in range(10)], "index long, word string, vector array<double>")
    trained = clustering.kmeans_train(df, k=5, iterations=3)
    assert clustering.wsse(df, trained).head()[0] == 0.0


def test_steps_store_and_resume(spark, words, tmp_path):
    path = str(tmp_path)

    def keep(iteration, centroids):
        tables.save_centroids(centroids, path, "m", 3, 2, iteration)

    states = clustering.kmeans_in_steps(words, 3, 6, 2, runs=2, on_step=keep)
    assert [i for i, _ in states] == [2, 4, 6]
    resumed = clustering.kmeans_in_steps(
        words, 3, 6, 2, runs=2, resume=(2, tables.load_centroids(spark, path, "m", 3, 2, 2)), on_step=None
    )
    assert [i for i, _ in resumed] == [4, 6]
    assert np.allclose(matrix_of(resumed[-1][1]), matrix_of(tables.load_centroids(spark, path, "m", 3, 2, 6)))
    with pytest.raises(ValueError):
        clustering.kmeans_in_steps(words, 3, 5, 2)
    assert clustering.iterations_per_checkpoint(100, 10) == 10
    with pytest.raises(ValueError):
        clustering.iterations_per_checkpoint(3, 5)


def test_a_step_cut_off_half_way_is_ignored(spark, words, tmp_path):
    path = str(tmp_path / "states")
    assert tables.last_complete_step(spark, path, "m", 3, 1) is None

    def keep(iteration, centroids):
        tables.save_centroids(centroids, path, "m", 3, 1, iteration)

    states = clustering.kmeans_in_steps(words, 3, 6, 2, on_step=keep)
    # Step 10 of the same model and a state of another one; then the last step loses what is written last.
    tables.save_centroids(states[0][1], path, "m", 30, 1, 90)
    assert tables.last_complete_step(spark, path, "m", 3, 1)[0] == 6
    (tmp_path / "states" / tables.state_name("m", 3, 1, 6) / tables.COMPLETE).unlink()
    found = tables.last_complete_step(spark, path, "m", 3, 1)
    assert found[0] == 4 and np.allclose(matrix_of(found[1]), matrix_of(states[1][1]))
    again = clustering.kmeans_in_steps(words, 3, 6, 2, resume=found, on_step=keep)
    assert [i for i, _ in again] == [6] and np.allclose(matrix_of(again[0][1]), matrix_of(states[2][1]))
    assert tables.last_complete_step(spark, path, "m", 3, 1)[0] == 6


def test_members(spark, words, vectors):
    centres = np.r_[vectors[[290, 210, 7]], np.full((1, 5), 1e6)]
    nearest = distances(vectors, centres).argmin(axis=1)
    rows = clustering.cluster_members(words, table(spark, centres)).collect()
    assert len(rows) == len(vectors) and {r["cluster"] for r in rows} == set(nearest.tolist())
    for r in rows:
        first = int(np.flatnonzero(nearest == r["cluster"])[0])
        assert (r["representative_index"], r["representative"]) == (first, f"w{first}")
        assert r["cluster"] == nearest[r["index"]]


def test_both_assignment_paths_give_the_same_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", [0.1, 0.0]), (1, "b", [5.0, 4.0]), (2, "c", [nan, 1.0]), (3, "d", [0.0, 0.0]), (4, "e", [inf, 0.0]), (5, "f", [5.0, 5.0])]
    df = spark.createDataFrame(rows, "index long, word string, vector array<double>")
    centers = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 5.0]), (2, [9.0, 0.0])], clustering.CENTROIDS)
    whole = sorted(map(tuple, clustering.assign_clusters(df, centers).collect()))
    blocks = sorted(map(tuple, clustering.assign_clusters(df, centers, broadcast_bytes=40).collect()))
    assert whole == blocks
    assert [(r[1], r[2]) for r in whole] == [("a", 0), ("b", 1), ("c", None), ("d", 0), ("e", None), ("f", 1)]
    means = {r["cluster"]: r["center"] for r in clustering.lloyd_step(df, centers).collect()}
    assert means == {0: [0.05, 0.0], 1: [5.0, 4.5], 2: [9.0, 0.0]}
    assert {r["cluster"]: r["center"] for r in clustering.lloyd_step(df, centers, broadcast_bytes=40).collect()} == means
