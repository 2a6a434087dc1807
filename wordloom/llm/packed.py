"""Which fingerprints occur in more than one chunk of a corpus: packed numbers are shuffled there, packed bits back."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import text_bytes

# Bytes of text that one Python call holds, and fingerprints that one bucket holds, on average.
CHUNK_BYTES = 8_000_000
BUCKET_NUMBERS = 1_000_000
# Bytes of text turned into fingerprints at a time.
PIECE_BYTES = 1_000_000

GOLD = np.uint64(0x9E3779B97F4A7C15)
STEP = 0xD6E8FEB86659FD93


def mixed(values: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places; one to one."""
    x = values + GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of all windows: sum of value times STEP to the power of its place, then mixed.

    Hashes of 1, 2, 4 ... values double into one another, and those of the width's binary digits are joined.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, part, size, done, out = STEP, values, 1, 0, None
    while True:
        if width & size:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out + piece * np.uint64(pow(STEP, done, 1 << 64))
            done += size
        if 2 * size > width:
            return mixed(out)
        part = part[:-size] + part[size:] * np.uint64(power)
        power, size = power * power % (1 << 64), 2 * size


def in_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``chunk, doc_id, text`` dealt by chunk, and the bytes of all texts. Chunks are even by hash of id and text."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = text_bytes(rows)
    chunks = max(1, math.ceil(held / chunk_bytes))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(held / (8 * chunk_bytes)))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    return rows.withColumn("chunk", chunk).repartition(parts, "chunk"), held


def sorted_texts(table: pa.Table) -> tuple[pa.Table, list[str]]:
    """A chunk's rows in an order that does not depend on how they arrived; equal rows are interchangeable."""
    table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return table, table.column("text").to_pylist()


def pieces(sizes: list[int], limit: int = PIECE_BYTES) -> list[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= limit:
            out.append((start, i + 1))
            start, held = i + 1, 0
    return out + [(start, len(sizes))] * (start < len(sizes))


def buckets_for(numbers: int) -> int:
    return max(1, math.ceil(numbers / BUCKET_NUMBERS))


def _cuts(unique: np.ndarray, buckets: int) -> np.ndarray:
    """Ends of the buckets, which are even ranges of 64-bit numbers, in sorted numbers."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(unique, edges), [len(unique)]])


def gap_coded(numbers: np.ndarray) -> bytes:
    """Sorted distinct numbers as their first and the gaps between them, each in as few bytes as the widest gap needs."""
    gaps = np.diff(numbers)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + numbers[:1].tobytes() + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def gap_decoded(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :width] = raw
    return np.cumsum(steps.view(np.uint64).ravel())


def packed_rows(chunk: int, numbers: np.ndarray, buckets: int) -> pa.Table:
    """``chunk, bucket, numbers`` of a chunk's distinct numbers, gap-coded."""
    unique = np.unique(numbers)
    cuts = _cuts(unique, buckets)
    full = np.flatnonzero(np.diff(cuts))
    blobs = [gap_coded(unique[cuts[b] : cuts[b + 1]]) for b in full]
    return pa.table(
        {"chunk": pa.array([chunk] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()), "numbers": pa.array(blobs, pa.binary())}
    )


PACKED = "chunk int, bucket int, numbers binary"


def shared_flags(packed: DataFrame) -> DataFrame:
    """``chunk, bucket, flags``: a bit per number of a row, set where the number is in another chunk's row as well.

    A chunk names each of its numbers once, so a number that fills a third of the corpus is one entry per chunk.
    Rows without a set bit are left out. Rows of buckets below 0 are notes of a chunk to itself and pass as they are.
    """

    def compare(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        if bucket < 0:
            return rows.rename_columns(["chunk", "bucket", "flags"])
        blobs = [gap_decoded(b.as_py()) for b in rows.column("numbers").combine_chunks()]
        every = np.sort(np.concatenate(blobs))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        chunks, flags = [], []
        for chunk, blob in zip(rows.column("chunk").to_pylist(), blobs):
            hit = found_in(blob, twice)
            if hit.any():
                chunks.append(chunk)
                flags.append(np.packbits(hit).tobytes())
        return pa.table(
            {"chunk": pa.array(chunks, pa.int32()), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "flags": pa.array(flags, pa.binary())}
        )

    return packed.groupBy("bucket").applyInArrow(compare, "chunk int, bucket int, flags binary")


def found_in(values: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Whether each value is among sorted distinct ones, by binary search."""
    if not len(those):
        return np.zeros(len(values), bool)
    at = np.searchsorted(those, values)
    at[at == len(those)] = 0
    return those[at] == values


def shared_numbers(unique: np.ndarray, flags: pa.Table, buckets: int) -> np.ndarray:
    """A chunk's sorted distinct numbers with what ``shared_flags`` says of them: True where shared."""
    cuts, shared = _cuts(unique, buckets), np.zeros(len(unique), bool)
    for bucket, bits in zip(flags.column("bucket").to_pylist(), flags.column("flags")):
        a, b = cuts[bucket], cuts[bucket + 1]
        shared[a:b] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8))[: b - a].astype(bool)
    return shared


def repeated_places(numbers: np.ndarray, flags: pa.Table, buckets: int) -> np.ndarray:
    """Whether each of a chunk's numbers occurs again, in the chunk or outside it."""
    unique, inverse, counts = np.unique(numbers, return_inverse=True, return_counts=True)
    return ((counts > 1) | shared_numbers(unique, flags, buckets))[inverse]


def per_chunk(rows: DataFrame, numbers: Callable[[pa.Table], np.ndarray], buckets: int) -> DataFrame:
    """The packed numbers of every chunk of ``in_chunks``."""

    def pack(table: pa.Table) -> pa.Table:
        return packed_rows(table.column("chunk")[0].as_py(), numbers(table), buckets)

    return rows.groupBy("chunk").applyInArrow(pack, PACKED)


def covered(starts: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that windows cover, as starts and ends, from sorted window starts."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.diff(starts) > width)
    return starts[np.concatenate([[0], new + 1])], starts[np.concatenate([new, [len(starts) - 1]])] + width
