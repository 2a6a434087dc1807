import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom import bounds
from wordloom.operators import kernels, nearest, pruned, topn
from wordloom.operators.kernels import LOWER_IS_BETTER

TABLE = "index long, word string, vector array<double>"
KEYS = ["qid", "metric", "rank", "index", "word", "score"]


def table(spark, vectors, parts=4):
    rows = [(i, f"w{i}", v.tolist()) for i, v in enumerate(vectors)]
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame(rows, TABLE).repartition(parts)


def asked(spark, vectors):
    return spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(vectors)], "qid string, vector array<double>")


def brute(vectors, queries, n, metric):
    found = {}
    for q, query in enumerate(queries):
        scored = []
        for i, v in enumerate(vectors):
            if "euclidean" in metric:
                score = ((v - query) ** 2).sum()
                score = score if metric.startswith("squared") else np.sqrt(score)
            else:
                lengths = np.linalg.norm(query) * (np.linalg.norm(v) if metric == "cosine" else 1.0)
                if lengths == 0:
                    continue
                score = (query * v).sum() / lengths
            scored.append((round(float(score if LOWER_IS_BETTER[metric] else -score), 9), i))
        found[f"q{q}"] = [i for _, i in sorted(scored)[:n]]
    return found


def indexes(df):
    found = {}
    for r in df.orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["index"])
    return found


def data(rows=400, dimensions=6, queries=9, seed=5):
    rng = np.random.default_rng(seed)
    return rng.integers(-4, 5, size=(rows, dimensions)).astype(float), rng.normal(size=(queries, dimensions))


@pytest.mark.parametrize("metric", sorted(LOWER_IS_BETTER))
@pytest.mark.parametrize("n", [1, 7])
def test_against_brute_force(spark, metric, n):
    # Small integers make many equal vectors, so ties are frequent; the constant keeps unequal ones from being parallel.
    vectors, queries = data(dimensions=4)
    vectors[:, 3] = 1.0
    vectors[17] = 0.0
    found = nearest.find_nearest_multi(table(spark, vectors), asked(spark, queries), n, metric)
    assert indexes(found) == brute(vectors, queries, n, metric)
    assert [f.name for f in found.schema] == KEYS


@pytest.mark.parametrize("limit", ["queries", "rows", "neither"])
def test_each_side_may_be_the_small_one(spark, limit):
    vectors, queries = data(300, 6, 40)
    if limit == "rows":
        vectors, queries = queries, vectors
    row_bytes = 8 * 6 + 64
    size = {"queries": 100, "rows": 100, "neither": 25}[limit] * row_bytes
    df, q = table(spark, vectors), asked(spark, queries)
    metrics = ["euclidean", "cosine"]
    found = nearest.find_nearest_multi(df, q, 3, metrics, broadcast_bytes=size)
    for metric in metrics:
        assert indexes(found.filter(F.col("metric") == metric)) == brute(vectors, queries, 3, metric)


def clustered(rows, groups=40, dimensions=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dimensions)) * 10
    return centres[rng.integers(0, groups, rows)] + rng.normal(size=(rows, dimensions)) * 0.1


@pytest.mark.parametrize("metrics", [["euclidean"], ["squared_euclidean", "cosine"], ["cosine"], ["normalized_cosine"]])
def test_cells_give_the_rows_of_the_scan(spark, metrics):
    vectors = clustered(2000)
    vectors[5], vectors[::7] = 0.0, vectors[0]  # a vector without length, and many copies of another
    queries = np.r_[clustered(60, seed=4), np.zeros((1, 8)), vectors[:3]]
    df, q = table(spark, vectors), asked(spark, queries)
    odd = spark.createDataFrame([(5000, "odd", [float("nan")] + [1.0] * 7), (5001, "far", [float("inf")] + [1.0] * 7)], TABLE)
    df = df.union(odd)
    scan = nearest.find_nearest_multi(df, q, 3, metrics).collect()
    cells = nearest.find_nearest_multi(df, q, 3, metrics, broadcast_bytes=4000).collect()
    assert sorted(scan) == sorted(cells)


def test_most_pairs_of_queries_and_cells_are_not_joined(spark):
    vectors, queries = clustered(4000), clustered(300)
    df, q = table(spark, vectors), asked(spark, queries)
    done = pruned.search(df, q, 3, ["euclidean"], nearest._schema(q.schema["qid"].dataType), 20_000)
    joined, every = done.pairs()
    assert every > 300 * 50 and joined < 0.2 * every
    # Rows move once for the cells of each round, not once per block of queries.
    plan = done.answers._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unknown_bounds_rule_nothing_out():
    cells = pruned.Cells(np.zeros((1, 3)), np.array([4]), np.array([0.0]), np.array([1.0]), np.array([1.0]))
    queries = np.array([[9.0, 0.0, 0.0], [1.5, 0.0, 0.0]])
    assert cells.out_of_reach(queries, "euclidean", np.array([0.6, 0.6])).tolist() == [[True], [False]]
    assert not cells.out_of_reach(queries, "euclidean", np.array([np.nan, np.nan])).any()


def test_rows_that_are_no_numbers_are_not_ranked_and_disturb_no_others(spark):
    vectors, queries = data(50, 4, 3)
    rows = [(i, f"w{i}", v.tolist()) for i, v in enumerate(vectors)]
    odd = [(90, "nan", [float("nan"), 0.0, 0.0, 0.0]), (91, "inf", [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, TABLE).coalesce(1)
    q = asked(spark, np.r_[queries, [[np.inf, 1.0, 0.0, 0.0]], [[np.nan, 1.0, 0.0, 0.0]]])
    for metric in sorted(LOWER_IS_BETTER):
        assert indexes(nearest.find_nearest_multi(df, q, 2, metric)) == brute(vectors, queries, 2, metric)


def test_many_copies_of_one_vector(spark):
    # A third of the rows are the same vector, which is also the best answer.
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(30_000, 8))
    vectors[::3] = vectors[0]
    queries = np.r_[vectors[:1] * 2, rng.normal(size=(300, 8))]
    found = nearest.find_nearest_multi(table(spark, vectors, 3), asked(spark, queries), 4, ["euclidean", "cosine"])
    first = found.filter("qid = 'q0' and metric = 'cosine'").orderBy("rank").collect()
    assert [r["index"] for r in first] == [0, 3, 6, 9]
    assert len({r["score"] for r in first}) == 1
    distance = np.sqrt(((vectors[:, None, :] - queries[None, 290:, :]) ** 2).sum(axis=2))
    for q in range(290, 301):
        got = [r["index"] for r in found.filter(f"qid = 'q{q}' and metric = 'euclidean'").orderBy("rank").collect()]
        assert got == np.lexsort((np.arange(len(vectors)), distance[:, q - 290]))[:4].tolist()


def test_one_query_and_batch_agree_and_partitioning_does_not_matter(spark):
    vectors, queries = data()
    for metric in ("euclidean", "cosine"):
        results = []
        for parts in (1, 7):
            df = table(spark, vectors, parts)
            single = nearest.find_nearest(df, queries[0].tolist(), 5, metric).collect()
            batch = nearest.find_nearest_multi(df, asked(spark, queries[:1]), 5, metric).orderBy("rank").collect()
            assert [tuple(r) for r in single] == [(r["index"], r["word"], r["score"]) for r in batch]
            results.append(single)
        assert results[0] == results[1]
        one = nearest.find_nearest_multi(df, asked(spark, queries), 1, metric).collect()
        many = nearest.find_nearest_multi(df, asked(spark, queries), 4, metric).filter("rank = 1").collect()
        assert sorted(one) == sorted(many)


def test_fewer_rows_than_asked_for(spark):
    vectors, queries = data(3, 4, 2)
    found = nearest.find_nearest_multi(table(spark, vectors), asked(spark, queries), 10, "euclidean")
    assert {q: len(rows) for q, rows in indexes(found).items()} == {"q0": 3, "q1": 3}


def test_zero_vectors_have_no_cosine(spark):
    vectors, queries = data(20, 4, 2)
    vectors[3], queries[1] = 0.0, 0.0
    df = table(spark, vectors)
    found = indexes(nearest.find_nearest_multi(df, asked(spark, queries), 50, "cosine"))
    assert sorted(found) == ["q0"] and len(found["q0"]) == 19 and 3 not in found["q0"]
    assert nearest.find_nearest(df, [0.0] * 4, 5, "cosine").count() == 0


def test_close_distances_are_told_apart(spark):
    # Far from the origin the expanded form of the distance loses most digits.
    base = np.full(4, 1e6)
    vectors = np.array([base + [d, 0, 0, 0] for d in (3e-3, 1e-3, 2e-3, 1e-3)])
    found = nearest.find_nearest_multi(table(spark, vectors), asked(spark, base[None, :]), 3, "euclidean")
    assert indexes(found) == {"q0": [1, 3, 2]}


def test_bad_input(spark):
    vectors, queries = data(5, 4, 1)
    df, q = table(spark, vectors), asked(spark, queries)
    with pytest.raises(ValueError):
        nearest.find_nearest_multi(df, q, 0)
    with pytest.raises(ValueError):
        nearest.find_nearest_multi(df, q, 1, "manhattan")
    ragged = df.union(spark.createDataFrame([(99, "x", [1.0])], TABLE))
    with pytest.raises(Exception, match="sizes differ"):
        nearest.find_nearest_multi(ragged, q, 1).collect()
    assert nearest.find_nearest_multi(df.limit(0), q, 1).count() == 0
    assert nearest.find_nearest_multi(df, q.limit(0), 1).count() == 0


def test_nearest_by_any_score(spark):
    df = spark.createDataFrame([(i, f"w{i}", [float(i % 4), 1.0]) for i in range(9)] + [(9, "odd", [float("nan"), 1.0])], "index long, word string, vector array<double>")
    found = nearest.find_nearest_by(df, F.abs(F.col("vector")[0] - 2.2), 3, lower_is_better=True).collect()
    assert [(r["index"], r["vector"]) for r in found] == [(2, [2.0, 1.0]), (6, [2.0, 1.0]), (3, [3.0, 1.0])]
    assert [r["index"] for r in nearest.find_nearest_by(df, F.col("vector")[0], 2, lower_is_better=False).collect()] == [3, 7]


def test_many_places_are_counted_in_the_size_check():
    assert nearest._room(1000, 1, 10, 1) > nearest._room(1000, 100, 10, 2)


def test_top_n_beyond_the_limit_of_the_group_plan(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    top = topn.top_n_per_group(df, ["g"], [F.desc("v")], 1500)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") == 2  # each partition gives its best only, to the parts and to their meeting
    rows = top.collect()
    assert len(rows) == 3000 and all(r["rank"] == (29_999 - r["v"]) // 2 + 1 for r in rows)


@pytest.mark.parametrize("metric", sorted(LOWER_IS_BETTER))
@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e90, 1e-140])
def test_rough_products_lose_no_row(metric, scale):
    # Lengths from tiny to large, rows without length, copies, and rows that differ by less than single precision shows.
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 7)) * np.exp(rng.normal(size=(3000, 1)) * 2)
    vectors[::50] = 0.0
    vectors[1::9] = vectors[1]
    vectors[2::11] = vectors[2] * (1 + 1e-12 * np.arange(len(vectors[2::11])))[:, None]
    queries = np.r_[vectors[:40] * 1.5, rng.normal(size=(40, 7)) * 3, -vectors[2:3]] * scale
    vectors *= scale
    held = kernels.Best(queries, 4, metric)
    words = pa.array([f"w{i}" for i in range(3000)])
    for start in range(0, 3000, 1000):
        block = kernels.Block(np.arange(start, start + 1000), kernels.Words(words.slice(start, 1000)), vectors[start : start + 1000])
        kernels.scan_block([held], block, held.directions())
    norms, own = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    for q, query in enumerate(queries):
        with np.errstate(all="ignore"):
            if "euclidean" in metric:
                key = ((query - vectors) ** 2).sum(axis=1)
                key = np.sqrt(key) if metric == "euclidean" else key
            elif metric == "cosine":
                key = np.where(norms > 0, -((query * vectors).sum(axis=1) / (own[q] * norms)), np.inf)
            else:
                key = -((query / own[q]) * vectors).sum(axis=1)
        best = np.lexsort((np.arange(3000), key))[:4] if own[q] > 0 or "euclidean" in metric else []
        assert held.index[q][: len(best)].tolist() == list(best)
    query, _, index, word, _ = held.results()
    assert word.tolist() == [f"w{i}" for i in index]


def test_what_is_moved_does_not_grow_with_the_cells(spark):
    # No bound helps among vectors without clusters, so every query is left with nearly every cell.
    rng = np.random.default_rng(4)
    vectors, queries = rng.normal(size=(3000, 16)), rng.normal(size=(200, 16))
    df, q = table(spark, vectors), asked(spark, queries)
    done = pruned.search(df, q, 3, ["euclidean", "cosine"], nearest._schema(q.schema["qid"].dataType), 20_000)
    joined, every = done.pairs()
    assert joined > 0.9 * every > 200 * 20
    assert done.second.count() <= 200


@pytest.mark.parametrize("metrics", [["euclidean", "cosine"], ["squared_euclidean"], ["normalized_cosine"]])
def test_many_tiles_give_the_rows_of_the_scan(spark, monkeypatch, metrics):
    monkeypatch.setattr(pruned, "LEAST_TILE_BYTES", 500)
    monkeypatch.setattr(pruned, "TILE_BYTES", 30_000)
    monkeypatch.setattr(pruned, "ROUND_BYTES", 20_000)
    vectors = np.r_[clustered(1500), np.random.default_rng(1).normal(size=(500, 8))]
    vectors[::3] = vectors[0]  # a cell that lies in several runs
    queries = np.r_[clustered(60, seed=4), vectors[:40], np.zeros((1, 8))]
    df, q = table(spark, vectors), asked(spark, queries)
    scan = nearest.find_nearest_multi(df, q, 5, metrics).collect()
    cells = nearest.find_nearest_multi(df, q, 5, metrics, broadcast_bytes=4000)
    assert sorted(scan) == sorted(cells.collect())


def test_runs_of_cells_are_even_and_hold_every_row():
    held = np.array([5, 0, 700, 3, 92])
    cells = pruned.Cells(np.arange(15.0).reshape(5, 3), held, np.zeros(5), np.ones(5), np.ones(5))
    line = pruned._line(cells, 8)
    places = np.concatenate([line.start[c] + np.arange(n) for c, n in enumerate(held)])
    assert sorted(places) == list(range(800))
    assert np.bincount(places * 8 // 800).tolist() == [100] * 8
    cover = line.cover()
    assert not cover[1].any()
    for c, n in enumerate(held):
        assert set(np.flatnonzero(cover[c])) == set(((line.start[c] + np.arange(n)) * 8 // 800).tolist())


@pytest.mark.parametrize("limit", [nearest.QUERY_BYTES, 500])
def test_stored_side_is_not_fetched(spark, tmp_path, monkeypatch, limit):
    # Both copied sides, queries and table, are read by the tasks; ids of any type and paths with blanks come through.
    vectors = np.random.default_rng(3).normal(size=(6, 4))
    ids = [datetime.datetime(1500 + 200 * i, 1, 2, 3, 4, 5, i) for i in range(20)]
    queries = np.random.default_rng(4).normal(size=(20, 4))
    rows = [(i, q.tolist()) for i, q in zip(ids, queries)]
    df, asked_for = table(spark, vectors), spark.createDataFrame(rows, "qid timestamp_ntz, vector array<double>")
    monkeypatch.setattr(bounds, "shared_dir", lambda _: f"{tmp_path}/a folder%20")
    monkeypatch.delattr(type(df), "toArrow")
    got = {}
    for r in nearest.find_nearest_multi(df, asked_for, 2, "euclidean", limit).orderBy("qid", "rank").collect():
        got.setdefault(f"q{ids.index(r['qid'])}", []).append(r["index"])
    assert got == brute(vectors, queries, 2, "euclidean")
