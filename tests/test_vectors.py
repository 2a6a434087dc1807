import math

import pytest
from pyspark.sql import functions as F

from wordloom.functions import vectors as V


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([([3.0, 4.0], [1.0, -2.0])], "a array<double>, b array<double>")


def value(df, column):
    return df.select(column.alias("x")).head()["x"]


def test_arithmetic(pair):
    assert value(pair, V.vec_add("a", "b")) == [4.0, 2.0]
    assert value(pair, V.vec_sub("a", "b")) == [2.0, 6.0]
    assert value(pair, V.vec_dot("a", "b")) == -5.0
    assert value(pair, V.vec_norm("a")) == 5.0
    assert value(pair, V.unit_vector("a")) == [0.6, 0.8]
    assert value(pair, V.squared_distance("a", "b")) == 40.0
    assert value(pair, V.euclidean("a", "b")) == math.sqrt(40)
    cosine = -5 / (5 * math.sqrt(5))
    assert math.isclose(value(pair, V.cosine_similarity("a", "b")), cosine)
    assert math.isclose(value(pair, V.cosine_distance("a", "b")), 1 - cosine)
    assert value(pair, V.query_vector("a", "b", "a")) == [1.0, -2.0]
    assert value(pair, V.vec_dot("a", V.literal_vector([1, 1]))) == 7.0


@pytest.mark.parametrize("operation", [V.vec_add, V.vec_sub, V.vec_dot, V.euclidean, V.squared_distance, V.cosine_similarity])
def test_sizes_must_match(spark, operation):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="vector sizes differ"):
        df.select(operation("a", "b")).collect()


def test_normalized(spark):
    df = spark.createDataFrame([([0.6, 0.8],), ([0.6, 0.8 + 1e-9],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.is_normalized("v")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(V.is_normalized("v", 1e-6)).collect()] == [True, True, False]


def test_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert value(df, V.unit_vector("a")) == [0.0, 0.0]
    assert value(df, V.cosine_similarity("a", "b")) is None


def test_single_precision_is_widened(spark):
    df = spark.createDataFrame([([0.1],)], "v array<float>")
    assert df.select(V.as_vector("v")).dtypes[0][1] == "array<double>"
    assert value(df, V.as_vector("v"))[0] == pytest.approx(0.1, abs=1e-8) and value(df, V.as_vector("v"))[0] != 0.1
    assert value(df.withColumn("v", V.as_vector("v")), V.vec_scale("v", F.lit(2.0)))[0] == pytest.approx(0.2, abs=1e-7)
