"""Mixing sources to target weights: hash-random order within each source, prefix sums of words, an exact cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.bounds import settled
from wordloom.llm.common import WORD, columns_aside, whole_text, word_count
from wordloom.prefix import running_totals

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets per source: ``number, source, source_size, target``.

    ``sizes`` has one row per source with its ``source_size``. Sources by code point, the absent one last, take the
    weights in turn and share the total. A target stops at ``max_epochs`` times its source's size; in order of
    size per weight the stopping sources come first, so running sums over that order give the share of the others.
    The table has one row per source, which is why its ranks may be made in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name) - 1
    weighed = sizes.withColumn("number", number).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("number") % len(weights) + 1).cast("long")
    )
    weighed = weighed.withColumn("most", F.col("source_size") * max_epochs)
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "number")
    everything = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("most").over(before), F.lit(0))
    left = (F.sum("source_size").over(everything) - spent).cast("double")
    level = weighed.withColumn("level", left / F.sum("weight").over(after)).withColumn("place", F.row_number().over(by_room))
    open_one = F.when(F.col("most") / F.col("weight") > F.col("level"), F.struct("place", "level"))
    level = level.withColumn("level", F.min(open_one).over(everything)["level"])
    share = F.col("level") * F.col("weight")
    target = F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), share))
    return level.select("number", "source", "source_size", target.alias("target"))


def _key_columns(docs: DataFrame, seed: int) -> list:
    """The hash-random order of a document and what breaks its ties."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return [order.alias("order"), F.col("doc_id"), F.xxhash64("text").alias("content")]


def _placed(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    """Every document in its source's order with full epochs, the words of the last epoch before it and its own part."""
    order, doc_id, content = _key_columns(docs, seed)
    narrow = settled(docs.select(doc_id, F.col("source"), word_count().alias("size"), order, content))
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    targets = settled(targets).withColumnRenamed("source", "_source")
    numbered = narrow.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = running_totals(numbered, ["number"], ["order", "doc_id", "content"], "size", "before")
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("epochs", epochs)
    rest = goal - F.col("epochs") * F.col("source_size") - F.col("before")
    return placed.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """How many words the mix takes of every document: ``doc_id, size, source_size, target, taken``.

    Each source gives its whole target (rounded to a word): full epochs of all its documents, then documents in
    hash-random order up to the exact word, where the last one is cut. The order is the md5 of seed and doc_id, so
    reruns agree and the order does not depend on the text; rows of equal id follow the hash of their text.

    Absent texts have size 0 and are never taken; absent sources are one source; repeated rows count one by one; an
    absent doc_id takes part like any other. Empty tables give no rows. Columns beside those named are not read.
    """
    placed = _placed(docs, weights, max_epochs, seed)
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


@columns_aside
def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row per epoch, the last one cut after its last taken word.

    The texts are not moved: a source's cut is one place in its order, so each document compares itself with that
    place. Documents of which nothing is taken are left out; ``n_chars``, where there is one, follows a cut. When
    the cut falls among m rows equal in id and text, each of them gives an equal part, rounded down, so up to m - 1
    words of the target are left. A cut text is its first words joined by single spaces. Absent and wordless texts are never
    taken; columns of any name pass through; an empty table gives no rows.
    """
    placed = _placed(docs, weights, max_epochs, seed)
    cut_here = (F.col("part") > 0) & (F.col("part") + F.col("before") == F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    equal = placed.groupBy("number", "order", "doc_id", "content").agg(
        F.floor(F.sum("part") / F.count(F.lit(1))).alias("words"), F.max(cut_here).alias("is_cut"), F.max("size").alias("size")
    )
    place = F.min(F.when(F.col("is_cut"), F.struct("order", "doc_id", "content", "words", "size"))).alias("_cut")
    cuts = equal.groupBy("number").agg(place)
    sources = placed.groupBy("number").agg(F.first("source").alias("_source"), F.max("epochs").alias("_epochs"))
    rules = settled(sources.join(cuts, "number", "left").drop("number"))
    order, doc_id, content = _key_columns(docs, seed)
    rows = docs.join(rules, docs["source"].eqNullSafe(rules["_source"]))
    rows = rows.withColumn("_own", F.struct(order, doc_id, content)).withColumn("_last", F.expr("struct(_cut.order, _cut.doc_id, _cut.content)"))
    has_words = F.regexp_like(whole_text(), F.lit(WORD))
    whole_again = F.col("_cut").isNotNull() & (F.col("_own") < F.col("_last"))
    at_cut = F.col("_cut").isNotNull() & (F.col("_own") == F.col("_last"))
    full = (F.col("_epochs") + F.when(whole_again | (at_cut & (F.col("_cut.words") == F.col("_cut.size"))), 1).otherwise(0)).cast("int")
    part = F.when(at_cut & (F.col("_cut.words") < F.col("_cut.size")) & (F.col("_cut.words") > 0), F.array(F.col("_cut.words").cast("int")))
    copies = F.concat(F.array_repeat(F.lit(-1), full), F.coalesce(part, F.expr("array_repeat(-1, 0)")))
    rows = rows.filter(has_words).withColumn("_words", F.explode(copies))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("_words"), F.lit(0))), " ")
    changed = {"text": F.when(F.col("_words") < 0, F.col("text")).otherwise(cut)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_words") < 0, F.col("n_chars")).otherwise(F.length(cut).cast("long"))
    return rows.withColumns(changed).select(*docs.columns)
