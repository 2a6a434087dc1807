"""Merkle manifest of a dataset by slot pivots: conditional aggregates lay the children of each parent side by side."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.bounds import settled
from wordloom.llm.common import whole_text
from wordloom.prefix import running_totals

FANOUT = 16
# One row in so many, by checksum of its id, is tampered with in the trial.
TAMPERED_ONE_IN = 5


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the inputs put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def measured(column: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; an absent one as a dash."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column) -> Column:
    """The digest of a document whose text is ``text``."""
    return digest(*[measured(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], measured(text))


def pivoted(nodes: DataFrame, carried: list[str], fanout: int = FANOUT) -> DataFrame:
    """One row per parent: ``tree, held, place, digest, c0, c1, ...`` from the nodes ``tree, held, place, digest, carried...``.

    ``held`` counts the nodes of a tree on its level and ``place`` counts them from 0; after the step both are those of
    the parents. Column ``ci`` is the child in slot i as a struct of its digest and the carried columns, absent where
    the last run is shorter. A parent's digest is that of all its slots in order, digests as text.
    """
    slot, child = F.pmod("place", F.lit(fanout)), F.struct("digest", *carried)
    slots = [F.max(F.when(slot == i, child)).alias(f"c{i}") for i in range(fanout)]
    parent = F.floor(F.col("place") / fanout).alias("above")
    runs = nodes.groupBy("tree", "held", parent).agg(*slots)
    own = digest(*[F.coalesce(F.col(f"c{i}.digest"), F.lit("")) for i in range(fanout)])
    rest = [f"c{i}" for i in range(fanout)]
    return runs.select("tree", F.ceil(F.col("held") / fanout).alias("held"), F.col("above").alias("place"), own.alias("digest"), *rest)


def unpivoted(runs: DataFrame, carried: list[str], fanout: int = FANOUT) -> DataFrame:
    """The children of each run with their siblings: ``tree, place, digest, carried..., before, after``, and ``path`` of the run.

    ``before`` and ``after`` are the digests in the slots left and right of a child's own: what it needs to make its
    parent's digest.
    """
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"c{i}").alias("child")) for i in range(fanout)])
    texts = F.array(*[F.coalesce(F.col(f"c{i}.digest"), F.lit("")) for i in range(fanout)])
    rows = runs.select("tree", (F.col("place") * fanout).alias("_first"), texts.alias("_texts"), "path", F.explode(slots).alias("_s"))
    rows = rows.filter("_s.child is not null")
    before = F.array_join(F.slice("_texts", 1, F.col("_s.slot")), "").alias("before")
    after = F.array_join(F.slice("_texts", F.col("_s.slot") + 2, fanout), "").alias("after")
    place = (F.col("_first") + F.col("_s.slot")).alias("place")
    return rows.select("tree", place, "_s.child.digest", *[F.col(f"_s.child.{c}").alias(c) for c in carried], before, after, "path")


def trees(nodes: DataFrame, most: int, carried: list[str], fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """All trees over ``nodes`` (``tree, held, place, digest, carried...``) at once: ``(tops, proofs)``.

    ``most`` is the size of the largest tree. ``tops`` is ``tree, digest``. ``proofs`` is ``tree, place, digest,
    carried..., path`` for every node, where ``path`` holds the siblings (``before``, ``after``) of the node and its
    ancestors from the bottom to the top.

    Upwards, each level is one grouping by parent: the 16 nodes of a run mostly lie in one task, so they meet before the
    shuffle; the number of levels is the logarithm of the largest tree, and each is stored in the shared folder. A
    hot tree spreads over all tasks, as the key is the parent, not the tree. Downwards, a run's path is joined once to
    the run of its children, which holds 16 of them; nodes themselves are never joined.
    """
    lone = nodes.filter("held = 1")
    tops, levels, kept = lone.select("tree", "digest"), [], carried
    while most > 1:
        runs = settled(pivoted(nodes.filter("held > 1"), kept, fanout))
        levels.append(runs)
        nodes, kept, most = runs.select("tree", "held", "place", "digest"), [], -(-most // fanout)
        tops = tops.unionByName(nodes.filter("held = 1").select("tree", "digest"))
    nothing = F.expr("cast(array() as array<struct<before: string, after: string>>)")
    alone = lone.select("tree", "place", "digest", *carried, nothing.alias("path"))
    paths = None
    for number in range(len(levels) - 1, -1, -1):
        runs, bottom = levels[number], number == 0
        ended = runs.filter("held = 1").withColumn("path", nothing)
        if paths is not None:
            joined = runs.filter("held > 1").join(paths.select("tree", "place", "path"), ["tree", "place"])
            ended = ended.unionByName(joined)
        children = unpivoted(ended, carried if bottom else [], fanout)
        paths = children.withColumn("path", F.concat(F.array(F.struct("before", "after")), "path")).drop("before", "after")
    return tops, alone if paths is None else alone.unionByName(paths)


def placed_leaves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(leaves, sources)``: ``tree, held, place, digest, doc_id, altered`` and ``source, tree, held``, trees numbered by source.

    ``altered`` is the leaf that the document would have with its text in small letters, for the rows of the trial.
    """
    small = F.translate(whole_text(), string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED_ONE_IN)) == 0
    altered = F.when(chosen & F.col("text").isNotNull(), leaf(small))
    rows = settled(docs.select("doc_id", "source", leaf(F.col("text")).alias("digest"), altered.alias("altered")))
    counts = settled(rows.groupBy("source").agg(F.count(F.lit(1)).alias("held")).withColumn("one", F.lit(1).cast("long")))
    # Sources in order of their bytes, the absent one first: their number is the place of their subtree.
    sources = settled(running_totals(counts, [], ["source"], "one", "tree").select("source", "tree", "held"))
    numbered = rows.join(sources.select(F.col("source").alias("_source"), "tree", "held"), F.col("source").eqNullSafe(F.col("_source")))
    numbered = numbered.select("tree", "held", "digest", "doc_id", "altered", F.lit(1).cast("long").alias("one"))
    return settled(running_totals(numbered, ["tree"], ["doc_id", "digest"], "one", "place").drop("one")), sources


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """A Merkle tree per source under one root, with every document's proof tried out.

    ``doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified, path``. Leaves of a source ascend by
    doc_id (absent ids first, repeated ones by digest); runs of 16 make a parent until one node is left; subroots, by source
    with the absent one first, likewise make the root. ``path`` lists the siblings from the leaf to the root; folding
    the leaf (or, for one row in five by checksum of its id, the leaf of the text in small letters) with them must give
    the root.

    Only digests move; texts are read once. Absent values count as a dash; an absent text stays absent in the trial, an
    absent id is never chosen for it; equal rows are leaves of their own with proofs of their own; a lone leaf is its
    source's subroot and a lone source's subroot is the root. An empty table gives no rows. Columns beside the five are
    not read, whatever their names.
    """
    leaves, sources = placed_leaves(docs)
    size = sources.agg(F.count(F.lit(1)).alias("sources"), F.max("held").alias("most")).head()
    tops, low = trees(leaves, size["most"] or 0, ["doc_id", "altered"], fanout)
    subroots = tops.select(F.lit(0).cast("long").alias("tree"), F.lit(size["sources"]).alias("held"), F.col("tree").alias("place"), "digest")
    subroots = settled(subroots)
    roots, high = trees(subroots, size["sources"], [], fanout)
    root = roots.head()
    # One row per source: its name, its subroot and the path from there to the root.
    tail = high.select(F.col("place").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("_high"))
    tail = settled(tail.join(sources.select("tree", "source"), "tree"))
    rows = low.join(tail, "tree").withColumn("path", F.concat("path", "_high"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate("path", F.coalesce("altered", "digest"), lambda node, s: digest(s["before"], node, s["after"]))
    rows = rows.withColumn("root", F.lit(root["digest"] if root else None).cast("string")).withColumn("folded_root", folded)
    return rows.select(
        "doc_id",
        "source",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
        "path",
    )
