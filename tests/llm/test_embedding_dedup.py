"""Links, components and partner counts against all pairs."""

import math

import numpy as np
import pytest

from wordloom.llm import embedding_dedup as dedup

SCHEMA = "vec_id long, embedding array<float>, label int, key string, copies int"


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(32) for _ in range(150)]
    for i in range(0, 60, 3):
        for noise in (0.02, 0.05, 0.3):
            out.append(out[i] + noise * rng.standard_normal(32) * np.linalg.norm(out[i]) / math.sqrt(32))
    center = rng.standard_normal(32)
    out += [center + 0.03 * rng.standard_normal(32) for _ in range(120)]  # one large group
    rows = [v.astype(np.float32).tolist() for v in out]
    return rows + [rows[5]] * 4 + [[2 * x for x in rows[5]], [-x for x in rows[5]], rows[6][:16], rows[7][:16], rows[7][:16]]


BAD = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31]


def plain(rows, cosine):
    good = [r is not None and len(r) > 0 and all(x is not None and math.isfinite(x) for x in r) and any(r) for r in rows]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for size in {len(r) for r, g in zip(rows, good) if g}:
        at = [i for i in range(n) if good[i] and len(rows[i]) == size]
        m = np.array([rows[i] for i in at], np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        linked[np.ix_(at, at)] = m @ m.T >= cosine
    np.fill_diagonal(linked, False)
    label = np.arange(n)
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(n)])
        if (new == label).all():
            return linked.sum(1), label
        label = new


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, block):
    rows = vectors() + BAD
    df = spark.createDataFrame([(i, r, 1, "x", 2) for i, r in enumerate(rows)] + [(None, rows[0], None, None, None)], SCHEMA)
    got = {r["vec_id"]: r for r in dedup.near_duplicates(df, 0.9, 1e-6, block).collect()}
    counts, label = plain(rows, 0.9)
    assert len(got) == len(rows) + 1 and got[None]["n_links"] == 0 and got[None]["component_id"] is None
    for i in range(len(rows)):
        r = got[i]
        assert (r["n_links"], r["component_id"], r["kept"]) == (counts[i], label[i], i == label[i]), i


def test_doubles_and_repeated_rows(spark):
    rows = [(1, [1.0, 1e-9]), (1, [1.0, 1e-9]), (2, [1e300, 0.0]), (3, [-0.0, 1e-300]), (4, [0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, dedup.near_duplicates(df).collect()))
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (4, 1, 3, False)]


def test_plan():
    for n in (10, 1000, 10**6):
        each, tables = dedup.table_plan(n)
        assert n * dedup.same_cell(math.sqrt(2)) ** each <= 0.1 * 1.001 or n < 10
        assert (1 - dedup.same_cell(math.sqrt(0.2)) ** each) ** tables <= dedup.MISSED
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((2000, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    other = unit + 0.3 / math.sqrt(16) * rng.standard_normal((2000, 16))
    apart = np.linalg.norm(unit - other, axis=1)
    keys = dedup.bucket_keys(np.concatenate([unit, other]), 1, 40)
    seen = (keys[:2000] == keys[2000:]).mean()
    assert seen == pytest.approx(np.mean([dedup.same_cell(d) for d in apart]), abs=0.02)


def test_forest():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 300, (2, 260))
    a, b = dedup.forest(x, y, 300)
    assert len(a) < 300

    def labels(p, q):
        out = np.arange(300)
        for _ in range(300):
            np.minimum.at(out, p, out[q])
            np.minimum.at(out, q, out[p])
        return out.tolist()

    assert labels(x, y) == labels(a, b)


def test_empty(spark):
    assert dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_default_plan_at_the_threshold(spark):
    """Pairs a little above the threshold, with the registered share that may be missed."""
    rng = np.random.default_rng(8)
    left = rng.standard_normal((1000, 32))
    left /= np.linalg.norm(left, axis=1, keepdims=True)
    side = rng.standard_normal((1000, 32))
    side -= (side * left).sum(1, keepdims=True) * left
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    right = 0.9005 * left + math.sqrt(1 - 0.9005**2) * side
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([left, right]))], "vec_id long, embedding array<double>")
    found = {(r["vec_id"], r["component_id"]) for r in dedup.near_duplicates(df).collect() if r["n_links"]}
    assert sum((i + 1000, i) in found for i in range(1000)) >= 990


@pytest.mark.parametrize("noise, block", [(0.05, 64), (0.22, 64), (0.22, 1024)])
def test_crowded_places(spark, noise, block):
    """One place wholly within a ball, and others beyond it, with vectors in neither; zeros and sizes of any scale."""
    rng = np.random.default_rng(5)
    center = rng.standard_normal(32)
    rows = [(center + noise * rng.standard_normal(32)) * 10.0 ** rng.integers(-150, 150) for _ in range(300)]
    rows += [center + 0.4 * rng.standard_normal(32) for _ in range(80)] + list(rng.standard_normal((60, 32))) + [rows[0]] * 3
    rows = [list(map(float, r)) for r in rows]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in dedup.near_duplicates(df, 0.9, 1e-6, block).collect()}
    unit = [list(np.array(r) / np.abs(r).max()) for r in rows]
    counts, label = plain(unit, 0.9)
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(rows))] == list(zip(counts, label))


def test_repeated_buckets_over_batches_and_partitions():
    def batch(*rows):
        return dedup.pa.RecordBatch.from_arrays([dedup.pa.array(c) for c in zip(*rows)], ["rep", "at", "key"])

    def kept(*batches):
        return [r["rep"] for b in dedup._repeated(iter(batches)) for r in b.to_pylist()]

    # The ends stay; inside, single rows go, also where a bucket goes on in the next batch.
    assert kept(batch((1, 0, 1), (2, 0, 2), (3, 0, 3)), batch((4, 0, 3), (5, 0, 4)), batch((6, 1, 4), (7, 1, 5))) == [1, 3, 4, 7]
    assert kept(batch((1, 0, 1))) == [1] and kept() == []
    assert kept(batch((1, 0, 1), (2, 0, 2)), batch((3, 0, 2)), batch((4, 0, 2), (5, 0, 9), (6, 0, 9))) == [1, 2, 3, 4, 5, 6]
