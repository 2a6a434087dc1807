"""The registered queries of the training-data operators: each over its whole table, by its operator."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wordloom.bounds import shared_dir
from wordloom.llm import bpe, embedding_dedup, main_text, merkle, mixing, pii, quality, repair, sharding, simhash, substring, suffix, whitening
from wordloom.llm.common import table


def op1_embedding(spark, d):
    return embedding_dedup.near_duplicates(table(spark, d, "embeddings"))


def op2_mixing(spark, d):
    return mixing.mix(table(spark, d, "documents"))


def op3_quality(spark, d):
    return quality.assess(table(spark, d, "documents"))


def op4_substring(spark, d):
    rows = substring.without_repeats(table(spark, d, "documents"))
    removed = F.expr("cast(aggregate(spans, 0L, (n, s) -> n + s.end - s.start) as bigint)")
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_pii(spark, d):
    found = pii.find_personal(table(spark, d, "documents"))
    counts = [pii.count_kind("_b", k).alias(f"n_{k}") for k in pii.KINDS]
    digest = F.sha2(pii.span_text("_b").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.span_text("_spans").alias("spans"))


def op6_suffix_array(spark, d):
    rows = suffix.without_repeats(table(spark, d, "documents"))
    removed = F.expr("cast(aggregate(spans, 0L, (n, s) -> n + s.end - s.start) as bigint)")
    spans = F.size("spans").cast("long")
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def vocabulary(name: str) -> str:
    """Where the environment keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_digest(rows):
    """Counts and digests of encoded and decoded documents."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_bpe(spark, d):
    path = vocabulary("word_bpe_49k.json")
    return bpe_digest(bpe.round_trip(table(spark, d, "documents"), path))


def op8_simhash(spark, d):
    rows = simhash.near_duplicates(table(spark, d, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_repair(spark, d):
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    repair.write_ids(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"), path)
    return repair.summaries(spark, path)


def op9_sharding(spark, d):
    rows = sharding.shard(table(spark, d, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def op11_whitening(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"))


def op12_main_text(spark, d):
    return main_text.extract(table(spark, d, "pages"))


def op13_merkle(spark, d):
    return merkle.manifest(table(spark, d, "documents")).drop("source", "path")


_ALL = (
    *(op1_embedding, op2_mixing, op3_quality, op4_substring, op5_pii, op6_suffix_array, op7_bpe),
    *(op8_simhash, op9_sharding, op10_repair, op11_whitening, op12_main_text, op13_merkle),
)
QUERIES = {f.__name__: f for f in _ALL}
