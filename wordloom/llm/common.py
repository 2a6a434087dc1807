"""Readers and words shared by the training-data operators."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The words of a text: runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, an absent one being empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of words of a text as a long; 0 for an absent one."""
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of UTF-8 in all texts: one number, by which work is cut into pieces of even size."""
    return df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).head()[0] or 0


# The columns of a document that the operators read.
READ = ("doc_id", "source", "lang", "n_chars", "text")


def columns_aside(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return their documents with all columns: those they do not read cannot clash with theirs.

    Other columns travel as one struct, under a name that none of them has, and come back in their places.
    """

    @functools.wraps(step)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        aside = [c for c in docs.columns if c not in READ]
        if not aside:
            return step(docs, *args, **kwargs)
        # No column of the table has this name, and no operator makes one that ends in a digit.
        name = "aside0"
        while name in docs.columns:
            name += "0"
        fields = F.struct(*[docs[f"`{c}`"].alias(f"f{i}") for i, c in enumerate(aside)]).alias(name)
        out = step(docs.select(*[c for c in docs.columns if c in READ], fields), *args, **kwargs)
        return out.select(*[F.col(c) if c in READ else F.col(name)[f"f{aside.index(c)}"].alias(c) for c in docs.columns])

    return run
