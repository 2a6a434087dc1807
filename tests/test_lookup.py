import pytest
from pyspark.sql import functions as F

from wordloom import bounds
from wordloom.operators import lookup, topn


@pytest.fixture(scope="module")
def words(spark):
    names = ["The", "the", "Cat", "cat", "CAT", "straße", "STRASSE", "concat", "Éa", "éA"]
    rows = [(len(names) - 1 - i, w, [float(i)]) for i, w in enumerate(names)]
    return spark.createDataFrame(rows, "index long, word string, vector array<double>").repartition(3)


def listed(df):
    return [(r["index"], r["word"]) for r in df.collect()]


def test_find(words):
    assert listed(lookup.find(words, F.col("index") > 2, 3)) == [(3, "STRASSE"), (4, "straße"), (5, "CAT")]
    assert lookup.find_all(words, F.col("index") > 2).count() == 7
    assert lookup.find(words, F.col("index") > 100, 3).count() == 0


def test_find_word_prefers_lowest_index(words):
    assert listed(lookup.find_word(words, "cAt")) == [(5, "CAT")]
    assert listed(lookup.find_word(words, "Cat", case_sensitive=True)) == [(7, "Cat")]
    assert listed(lookup.find_word(words, "dog")) == []
    assert listed(lookup.find_word(words, "ÉA")) == [(0, "éA")]


@pytest.mark.parametrize("limit", [100_000, 1])
def test_find_words(words, monkeypatch, limit):
    # With a limit of one row the shuffled joins are taken.
    monkeypatch.setattr(lookup, "small_or_settled", lambda df: bounds.small_or_settled(df, limit))
    asked = ["THE", "the", "cat", "Cat", "dog"]
    found = lookup.find_words(words, asked).collect()
    assert {r["query"]: (r["index"], r["word"], r["vector"]) for r in found} == {
        "THE": (8, "the", [1.0]),
        "the": (8, "the", [1.0]),
        "cat": (5, "CAT", [4.0]),
        "Cat": (5, "CAT", [4.0]),
    }
    exact = lookup.find_words(words, asked, case_sensitive=True).collect()
    assert {(r["query"], r["index"]) for r in exact} == {("the", 8), ("cat", 6), ("Cat", 7)}
    missing = lookup.missing_words(words, words.sparkSession.createDataFrame([(w,) for w in asked], "word string"))
    assert [r["word"] for r in missing.collect()] == ["dog"]


def test_search_flags(words):
    assert listed(lookup.search(words, "cat")) == [(5, "CAT"), (6, "cat"), (7, "Cat")]
    assert listed(lookup.search(words, "cat", limit=2)) == [(5, "CAT"), (6, "cat")]
    assert listed(lookup.search(words, "cat", case_sensitive=True)) == [(6, "cat")]
    assert listed(lookup.search(words, "AT", substring=True)) == [(2, "concat"), (5, "CAT"), (6, "cat"), (7, "Cat")]
    assert listed(lookup.search(words, "at", substring=True, case_sensitive=True)) == [(2, "concat"), (6, "cat"), (7, "Cat")]


@pytest.mark.parametrize("n", [1, 2, 5, 10, 20])
def test_top_n(spark, n):
    rows = [(c, (7 * i * (c + 1) + c) % 11) for c in range(5) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "column int, value int").repartition(4)
    found = topn.top_n_per_group(df, ["column"], [F.desc("value")], n).orderBy("column", "rank").collect()
    expected = [
        (c, v, k + 1) for c in range(5) for k, v in enumerate(sorted((v for g, v in rows if g == c), reverse=True)[:n])
    ]
    assert [tuple(r) for r in found] == expected


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = topn.top_n_per_group(df, ["g"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, ["g"], [F.desc("id")], 0)
