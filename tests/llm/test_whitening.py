"""Whitened vectors against a dense eigendecomposition."""

import os

import numpy as np
import pytest

from wordloom.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, x string, value int, component string"


def expected(vectors, wanted=4):
    """n, variances, components and trace over the distinct quantised vectors."""
    x = np.unique(np.floor(256 * np.asarray(vectors, dtype=np.float64)).astype(np.int64), axis=0)
    centred = x - x.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-e)[:wanted]
    return len(x), e[order], v[:, order].T, np.trace(centred.T @ centred) / len(x), x


def check(rows, ids, vectors, wanted=4, tolerance=1e-8):
    n, e, v, trace, x = expected(vectors, wanted)
    sums, own = x.sum(axis=0), np.floor(256 * np.asarray(vectors, dtype=np.float64)).astype(np.int64)
    got = {}
    for r in rows:
        got.setdefault(r["component"], []).append(r)
    assert sorted(got) == list(range(1, len(e) + 1))
    for c, part in got.items():
        assert sorted(r["vec_id"] for r in part) == sorted(ids)
        assert all(r["n"] == n for r in part)
        assert part[0]["explained"] == pytest.approx(e[c - 1] / trace, rel=1e-10) and part[0]["identity_error"] < 1e-8
        at = {i: k for k, i in enumerate(ids)}
        order = [at[r["vec_id"]] for r in part]
        z = (own - sums / n) @ v[c - 1] / np.sqrt(e[c - 1])
        mine = np.array([r["whitened"] for r in part])
        assert np.abs(mine - z[order]).max() < tolerance or np.abs(mine + z[order]).max() < tolerance
        assert [r["deviation"] for r in part] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(own[k], sums)) for k in order]


def frame(spark, vectors):
    return spark.createDataFrame([(i, list(map(float, v)), "x", 1, "c") for i, v in enumerate(vectors)], SCHEMA)


@pytest.mark.parametrize("d, seed", [(3, 0), (12, 1), (40, 2)])
def test_random_vectors(spark, d, seed):
    rng = np.random.default_rng(seed)
    vectors = np.float32(rng.standard_normal((300, d)) * np.linspace(3, 0.2, d) + rng.standard_normal(d) * 5)
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 200, axis=0)])
    check(whitening.whiten(frame(spark, vectors).repartition(3)).collect(), list(range(len(vectors))), vectors, min(4, d))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.collect()
    check(whitening.whiten(table).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_equal_variances(spark):
    # Four pairs of opposite corners on each axis: all six variances are the same but one.
    vectors = [s * np.eye(6)[i] * (2.0 if i == 3 else 1.0) for i in range(6) for s in (1, -1)]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    assert {r["component"] for r in rows} == {1, 2, 3, 4}
    explained = {r["component"]: r["explained"] for r in rows}
    assert explained[1] == pytest.approx(4 / 9) and all(explained[c] == pytest.approx(1 / 9) for c in (2, 3, 4))
    assert rows[0]["identity_error"] < 1e-9


def test_edge_rows(spark):
    rows = [(i, [float(i % 5), float(i // 5), 1.0], "x", 1, "") for i in range(25)] + [(None, [0.0, 0.0, 1.0], None, None, None)] * 2
    rows += [(100, None, "", 1, ""), (101, [1.0, None, 2.0], "", 1, ""), (102, [1.0, float("nan"), 2.0], "", 1, ""), (103, [float("inf"), 1.0, 1.0], "", 1, ""), (104, [], "", 1, "")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    # One direction never varies.
    assert {r["component"] for r in got} == {1, 2} and len(got) == 2 * 27 and {r["n"] for r in got} == {25}
    assert got[0]["identity_error"] < 1e-9
    same = spark.createDataFrame([(i, [1.0, 2.0], "", 1, "") for i in range(5)], SCHEMA)
    assert whitening.whiten(same).collect() == []
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_entries(spark):
    vectors = np.float32(np.random.default_rng(5).standard_normal((50, 4)) * [3e4, 2e4, 1e4, 5e3] + 4e4)
    got = whitening.whiten(frame(spark, vectors)).collect()
    check(got, list(range(50)), vectors, tolerance=1e-7)
    beyond = whitening.whiten(frame(spark, vectors * 100_000)).collect()
    assert any(r["deviation"] is None for r in beyond) and beyond[0]["identity_error"] < 1e-6
