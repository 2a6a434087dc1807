"""Filters and word lookups on the word table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.bounds import small_or_settled


def folded(c) -> Column:
    """Case-folded form of a word: two words are equal regardless of case when their folded forms are."""
    return F.lower(F.upper(F.col(c) if isinstance(c, str) else c))


def find_all(df: DataFrame, predicate: Column) -> DataFrame:
    """Every row that satisfies the predicate."""
    return df.filter(predicate)


def find(df: DataFrame, predicate: Column, n: int) -> DataFrame:
    """The first ``n`` matching rows in ascending order of index, that is, the most frequent words."""
    return df.filter(predicate).orderBy("index").limit(n)


def find_word(df: DataFrame, word: str, case_sensitive: bool = False) -> DataFrame:
    """The matching row of lowest index, or no row."""
    return find(df, _word_equals(word, case_sensitive), 1)


def search(df: DataFrame, query: str, limit: int = 10, case_sensitive: bool = False, substring: bool = False) -> DataFrame:
    """Index and word of the first ``limit`` matches, whole-word unless ``substring`` is set."""
    if substring:
        haystack, needle = (F.col("word"), F.lit(query)) if case_sensitive else (folded("word"), folded(F.lit(query)))
        predicate = F.contains(haystack, needle)
    else:
        predicate = _word_equals(query, case_sensitive)
    return find(df, predicate, limit).select("index", "word")


def find_words(df: DataFrame, words: DataFrame | Iterable[str], case_sensitive: bool = False) -> DataFrame:
    """Look up many words at once: ``query, index, word, vector`` for each word found, of lowest index.

    The first step settles the index per query on the two narrow columns, with a map-side minimum that keeps a
    very frequent spelling cheap; only the rows chosen are then read with their vectors.
    """
    if not isinstance(words, DataFrame):
        words = df.sparkSession.createDataFrame([(w,) for w in words], "word string")
    key = (lambda c: F.col(c)) if case_sensitive else folded
    wanted = small_or_settled(words.select(F.col("word").alias("query")).distinct()).withColumn("key", key("query"))
    chosen = (
        df.select("index", key("word").alias("key"))
        .join(wanted, "key")
        .groupBy("query")
        .agg(F.min("index").alias("index"))
    )
    return df.join(small_or_settled(chosen), "index").select("query", "index", "word", "vector")


def missing_words(df: DataFrame, words: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """The words that have no row in the table."""
    key = (lambda c: F.col(c)) if case_sensitive else folded
    wanted = small_or_settled(words.select("word").distinct()).withColumn("key", key("word"))
    known = df.select(key("word").alias("key")).join(wanted, "key", "left_semi").distinct()
    return wanted.join(known, "key", "left_anti").select("word")


def _word_equals(word: str, case_sensitive: bool) -> Column:
    return F.col("word") == word if case_sensitive else folded("word") == folded(F.lit(word))
