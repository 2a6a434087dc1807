import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom import bounds
from wordloom.operators import dimension_kernels, stats

POINTS = [stats.point(p) for p in stats.PERCENTILES]


def values(spark, groups, parts=4):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double").repartition(parts)


def expected(vs):
    return np.percentile(vs, stats.PERCENTILES, method="weibull")


def bins_of(vs, bins):
    low, high, counts = min(vs), max(vs), [0] * bins
    for v in vs:
        place = 0 if v == low else bins - 1 if v == high else min(int((v - low) / ((high - low) / bins)), bins - 1)
        counts[place] += 1
    return counts


def test_known_sample(spark):
    df = values(spark, {"a": range(-10, 11)})
    row = stats.describe(df, [], "v").head()
    assert (row["n"], row["min"], row["max"], row["mean"], row["p50"]) == (21, -10.0, 10.0, 0.0, 0.0)
    assert row["histogram"] == [2, 2, 2, 2, 2, 2, 2, 2, 2, 3]
    assert row["variance"] == pytest.approx(38.5) and row["stdev"] == pytest.approx(38.5**0.5)


def test_single_value_and_constant_group(spark):
    df = values(spark, {"one": [4.5], "same": [2.0] * 6})
    rows = {r["g"]: r for r in stats.describe(df, ["g"], "v", bins=4).collect()}
    assert all(rows["one"][c] == 4.5 for c in ("min", "max", "mean", *POINTS))
    assert (rows["one"]["stdev"], rows["one"]["variance"]) == (0.0, 0.0)
    assert rows["one"]["histogram"] == [1, 0, 0, 0] and rows["same"]["histogram"] == [6, 0, 0, 0]


@pytest.mark.parametrize("crowded", [1_000_000, 20])
@pytest.mark.parametrize("groups_limit", [100_000, 1])
def test_percentiles_of_skewed_groups(spark, crowded, groups_limit, monkeypatch):
    # A third of one group is a single value; outliers stretch the range; with a limit of one group nothing is broadcast.
    original = bounds.gathered
    monkeypatch.setattr(stats, "gathered", lambda df: original(df, groups_limit))
    rng = np.random.default_rng(4)
    groups = {
        "copies": np.r_[rng.normal(size=2000), [0.125] * 1000],
        "outliers": np.r_[rng.normal(size=500), [1e300, -1e300, 1e9, 5e-324, -0.0]],
        "few": [3.0, 1.0, 2.0],
        "integers": rng.integers(0, 4, size=900),
        None: rng.exponential(size=300),
    }
    df = values(spark, groups)
    found = {r["g"]: [r[p] for p in POINTS] for r in stats.exact_percentiles(df, ["g"], "v", crowded_rows=crowded).collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(found[g], expected(vs), rtol=1e-12, atol=1e-14), g


def test_many_equal_groups_and_missing_values(spark):
    df = spark.range(5000).select((F.col("id") % 50).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    rows = {r["g"]: r for r in stats.summary(df, ["g"], "v").collect()}
    for g in (0, 13, 49):
        vs = [i for i in range(5000) if i % 50 == g and i % 7]
        assert rows[g]["n"] == len(vs)
        assert np.allclose([rows[g][p] for p in POINTS], expected(vs))
        assert rows[g]["variance"] == pytest.approx(np.var(vs, ddof=1))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6, allow_subnormal=False), min_size=1, max_size=60), st.integers(1, 12))
def test_properties(spark, vs, bins):
    row = stats.describe(values(spark, {"a": vs}, 2), [], "v", bins).head()
    points = [row["min"], *[row[p] for p in POINTS], row["max"]]
    assert points == sorted(points) and sum(row["histogram"]) == len(vs) and len(row["histogram"]) == bins
    assert np.allclose([row[p] for p in POINTS], expected(vs), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 10, 11])
def test_quartiles(spark, count):
    vs = [float(x * x) for x in range(count)]
    row = stats.quartiles_exclusive(values(spark, {"a": vs}), [], "v").head()
    half = count // 2
    lower, upper = vs[:half], vs[count - half :]
    assert row["median"] == np.median(vs)
    assert (row["q1"], row["q3"]) == ((np.median(lower), np.median(upper)) if half else (None, None))


def words(spark, vectors):
    return spark.createDataFrame(
        [(i, f"w{i}", v.tolist()) for i, v in enumerate(vectors)], "index long, word string, vector array<double>"
    ).repartition(3)


@pytest.mark.parametrize("crowded", [1_000_000, 30])
@pytest.mark.parametrize("copied", [True, False])
def test_dimension_stats(spark, crowded, copied, monkeypatch):
    # With ``copied`` off the elements become rows, as they do when the table of ranges is too large to copy.
    if not copied:
        monkeypatch.setattr(stats, "gathered", lambda df: (df, None))
    rng = np.random.default_rng(6)
    vectors = rng.normal(loc=1e4, size=(700, 5))
    vectors[:, 1] = 7.0
    vectors[::3, 2] = 0.5
    vectors[5, 3] = 1e12
    rows = stats.dimension_stats(words(spark, vectors), 20, crowded).orderBy("dimension").collect()
    assert [r["dimension"] for r in rows] == list(range(5))
    for d, r in enumerate(rows):
        v = vectors[:, d]
        assert (r["n"], r["min"], r["max"]) == (700, v.min(), v.max())
        assert np.allclose([r["mean"], r["variance"]], [v.mean(), v.var(ddof=1)], rtol=1e-9)
        assert np.allclose([r[p] for p in POINTS], expected(v), rtol=1e-13)
        assert r["histogram"] == bins_of(v, 20)


def test_few_rows_and_ragged_vectors(spark):
    rows = stats.dimension_stats(words(spark, np.arange(6.0).reshape(2, 3))).orderBy("dimension").collect()
    assert [(r["p50"], sum(r["histogram"])) for r in rows] == [(1.5, 2), (2.5, 2), (3.5, 2)]
    one = stats.norm_stats(words(spark, np.array([[3.0, 4.0]]))).head()
    assert (one["n"], one["min"], one["p98"], one["variance"]) == (1, 5.0, 5.0, 0.0)
    ragged = words(spark, np.ones((2, 3))).union(words(spark, np.ones((2, 2))))
    with pytest.raises(Exception, match="sizes differ"):
        stats.model_shape(ragged).collect()
    with pytest.raises(Exception, match="sizes differ"):
        stats.dimension_stats(ragged).collect()


def test_outlier_bounds(spark):
    found = stats.describe(values(spark, {"a": range(101)}), [], "v")

    def bounds_of(*rule):
        row = stats.outlier_bounds(found, *rule).head()
        return row["range_low"], row["range_high"]

    row = found.head()
    assert bounds_of() == (0.0, 100.0)
    assert bounds_of("p2_p98") == (row["p2"], row["p98"])
    spread = row["p75"] - row["p25"]
    assert bounds_of("median_iqr") == (50 - spread, 50 + spread)
    assert bounds_of("median_iqr", 1.5) == (50 - 1.5 * spread, 50 + 1.5 * spread)
    with pytest.raises(ValueError):
        stats.outlier_bounds(found, "other")


def test_at_most_two_passes_over_the_rows(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 60_013).cast("double").alias("v"))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = rows.mapInArrow(count, rows.schema)
    found = {r["g"]: r for r in stats.summary(counted, ["g"], "v", crowded_rows=10_000).collect()}
    assert read.value <= 2 * 60_000
    for g in range(3):
        values = sorted(float(i * 7919 % 60_013) for i in range(60_000) if i % 3 == g)
        assert found[g]["p50"] == (values[9_999] + values[10_000]) / 2 and found[g]["n"] == 20_000


def test_ranks_outside_their_brackets_are_found_all_the_same(spark, monkeypatch):
    rows = spark.range(30_000).select((F.col("id") * 7919 % 30_011).cast("double").alias("v"))
    want = stats.exact_percentiles(rows, [], "v").head()
    assert stats.exact_percentiles(rows, [], "v", crowded_rows=10_000).head() == want
    monkeypatch.setattr(stats, "BRACKET_SHARE", -0.02)
    assert stats.exact_percentiles(rows, [], "v", crowded_rows=10_000).head() == want
    values = sorted(float(i * 7919 % 30_011) for i in range(30_000))
    assert want["p50"] == (values[14_999] + values[15_000]) / 2


def test_models_share_all_jobs(spark):
    def jobs(count):
        models = {f"m{i}": spark.range(50).select(F.array(F.col("id") + 0.5 * i, F.col("id") * 2.0).alias("vector")) for i in range(count)}
        group = f"models-{count}"
        spark.sparkContext.setJobGroup(group, group)
        rows = stats.analyze(models, 5).collect()
        spark.sparkContext.setJobGroup("", "")
        assert len(rows) == 3 * count and {r["words"] for r in rows} == {50}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(1) == jobs(4)


def test_bins_are_held_only_where_there_are_values():
    bins = dimension_kernels.Bins()
    for _ in range(3):
        bins.add(np.array([10**12, 5, 5]), np.array([1.0, -2.0, 4.0]))
    place, held, low, high = bins.total()
    assert place.tolist() == [5, 10**12] and held.tolist() == [6, 3] and low.tolist() == [-2.0, 1.0] and high.tolist() == [4.0, 1.0]


def test_nested_values_are_counted_in_bytes(spark):
    df = spark.createDataFrame([(["x" * 1000] * 10, ("y" * 500, 1))], "a array<string>, s struct<t: string, n: int>")
    assert 10_500 < bounds.value_bytes(df) < 11_000
    assert bounds.value_bytes(df.limit(0)) == 0
