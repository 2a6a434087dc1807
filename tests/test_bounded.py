"""K-means steps with bounds against full comparisons."""

import numpy as np
import pytest
from pyspark.errors import PythonException

from wordloom.operators import bounded, clustering
from wordloom.operators.kernels import nearest_centre
from tests.test_clustering import matrix_of, table

SCHEMA = "index long, word string, vector array<double>"


def clustered(rng, blobs, rows, dimensions, spread):
    means = rng.normal(size=(blobs, dimensions)) * spread
    return means[rng.integers(0, blobs, rows)] + rng.normal(size=(rows, dimensions))


def words_of(spark, vectors):
    return spark.createDataFrame([(i, f"w{i}", v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed, groups, spread", [(0, 1, 0.0), (1, 4, 1.0), (2, 7, 5.0), (3, 16, 20.0)])
def test_clusters_equal_full_comparison_and_bounds_hold_at_every_step(seed, groups, spread):
    rng = np.random.default_rng(seed)
    vectors = clustered(rng, 12, 500, 6, spread)
    vectors[:40] = np.round(vectors[:40])  # on a grid, so that some centres are equally far
    centres = np.concatenate([vectors[:40], vectors[:20], vectors[100:140]])
    members = bounded._grouped(centres, groups)
    assert sorted(np.concatenate(members).tolist()) == list(range(len(centres)))
    cluster, upper, lower = np.full(500, -1), np.full(500, np.inf), np.zeros((500, len(members)))
    moves = np.zeros(len(centres))
    for _ in range(12):
        known = cluster >= 0
        upper[known] = upper[known] * (1 + bounded.STEP_SLACK) + moves[cluster[known]] * (1 + bounded.SLACK)
        farthest = np.array([moves[own].max() for own in members])
        lower = lower * (1 - bounded.STEP_SLACK) - farthest * (1 + bounded.SLACK)
        bounded.reassign(vectors, cluster, upper, lower, centres, members)
        assert (cluster == nearest_centre(vectors, centres)[0]).all()
        exact = np.sqrt(((vectors[:, None] - centres[None]) ** 2).sum(axis=2))
        assert (exact[np.arange(500), cluster] <= upper).all()
        exact[np.arange(500), cluster] = np.inf
        assert all((lower[:, g] <= exact[:, own].min(axis=1)).all() for g, own in enumerate(members))
        moved = np.array([vectors[cluster == c].mean(axis=0) if (cluster == c).any() else centres[c] for c in range(len(centres))])
        moves, centres = np.sqrt(((moved - centres) ** 2).sum(axis=1)), moved


def test_centres_equal_plain_steps_and_later_steps_compare_little(spark):
    vectors = clustered(np.random.default_rng(5), 40, 3000, 8, 8.0)
    words, start = words_of(spark, vectors), table(spark, vectors[:80], range(100, 180))
    plain = clustering.kmeans_warm_start(words, start, 8, tolerance=0.0)
    found, shares = bounded.kmeans_with_bounds(words, start, 8, tolerance=0.0)
    assert [r["cluster"] for r in found.orderBy("cluster").collect()] == list(range(100, 180))
    np.testing.assert_allclose(matrix_of(found), matrix_of(plain), rtol=0, atol=1e-9)
    assert shares[0] == 1.0 and shares[-1] < 0.1 and shares[-1] < shares[1]


def test_stops_when_no_centre_moves(spark):
    vectors = clustered(np.random.default_rng(6), 4, 200, 3, 30.0)
    words = words_of(spark, vectors)
    _, shares = bounded.kmeans_with_bounds(words, table(spark, vectors[:10]), 50, tolerance=0.0)
    assert 1 < len(shares) < 50


def test_edge_rows(spark):
    centres = table(spark, np.array([[0.0, 0.0], [0.0, 0.0], [4.0, 0.0]]))
    rows = [(0, "a", [1.0, 0.0]), (0, "a", [1.0, 0.0]), (1, None, [float("nan"), 0.0]), (2, "b", [float("inf"), 1.0]), (3, "c", [2.0, 0.0])]
    found, _ = bounded.kmeans_with_bounds(spark.createDataFrame(rows, SCHEMA), centres, 1)
    # Equal centres and equal distances: the lowest cluster takes the row; the others keep their centres.
    np.testing.assert_allclose(matrix_of(found), [[4 / 3, 0.0], [0.0, 0.0], [4.0, 0.0]])
    same, shares = bounded.kmeans_with_bounds(spark.createDataFrame([], SCHEMA), centres, 3)
    assert matrix_of(same).tolist() == [[0, 0], [0, 0], [4, 0]] and shares == [0.0]
    none, shares = bounded.kmeans_with_bounds(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], clustering.CENTROIDS), 3)
    assert none.count() == 0 and shares == []
    with pytest.raises(PythonException, match="vector sizes differ"):
        bounded.kmeans_with_bounds(spark.createDataFrame([(0, "a", [1.0])], SCHEMA), centres, 1)


def test_centres_too_large_to_copy_take_plain_steps(spark):
    vectors = clustered(np.random.default_rng(7), 3, 60, 4, 9.0)
    words, start = words_of(spark, vectors), table(spark, vectors[:6])
    found, shares = bounded.kmeans_with_bounds(words, start, 3, tolerance=0.0, broadcast_bytes=8)
    np.testing.assert_allclose(matrix_of(found), matrix_of(clustering.kmeans_warm_start(words, start, 3, tolerance=0.0)), atol=1e-9)
    assert shares == []
