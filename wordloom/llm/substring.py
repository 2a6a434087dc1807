"""Substring dedup: windows of words that occur twice anywhere, merged into maximal intervals and removed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm import packed

WINDOW = 35
ODD = 0xB5026F5AA96619E9
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_ends(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 text."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def word_numbers(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, from running sums of bytes times powers, mixed with the word's length.

    The text is taken in stretches of whole words, so the sums stay small beside it.
    """
    size, out, first = packed.PIECE_BYTES, [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + size, "right")))
        a, b = int(starts[first]), int(ends[last - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8)[a:b].astype(np.uint64) + np.uint64(1)) * _powers(b - a, ODD), out=sums[1:])
        s, e = starts[first:last] - a, ends[first:last] - a
        back = _powers(b - a + 1, pow(ODD, -1, 1 << 64))
        out.append(packed.mixed((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64) * packed.GOLD))
        first = last
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def window_numbers(texts: list[bytes], width: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` words within each text, in order."""
    out = []
    for a, b in packed.pieces([len(t) for t in texts]):
        joined = b" ".join(texts[a:b])
        starts, ends = word_ends(joined)
        numbers = packed.rolling(word_numbers(joined, starts, ends), width)
        limits = np.cumsum([len(t) + 1 for t in texts[a:b]]) - 1
        # A window belongs to a text when its last word starts before the text ends.
        text_of = np.searchsorted(limits, starts, "right")
        inside = text_of[: len(numbers)] == text_of[width - 1 :] if len(numbers) else np.zeros(0, bool)
        out.append(numbers[inside])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def without_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, spans, kept``: maximal removal intervals in words, ends exclusive, and the words left.

    A word is removed when a window of ``width`` consecutive words that covers it starts at another place too, in any
    document. Every window of every text is hashed (Rabin-Karp, 64 bits) and all are counted: chunks of texts send
    their distinct hashes, packed, to buckets of the number line, which answer with a bit for each hash that another
    chunk has; the chunks then hash again and merge their repeated windows. With 64 bits, n windows bring about
    n^2 / 2^65 chance pairs: one in 2,000 runs over 10^8 windows.

    Absent texts are empty; texts shorter than a window lose nothing; equal rows remove each other's windows; an
    empty table gives no rows; columns beside doc_id and text are not read.
    """
    rows, held = packed.in_chunks(docs)
    buckets = packed.buckets_for(held // 6)

    def numbers(table: pa.Table) -> np.ndarray:
        return window_numbers([t.encode() for t in packed.sorted_texts(table)[1]], width)

    flags = packed.shared_flags(packed.per_chunk(rows, numbers, buckets))

    def remove(table: pa.Table, flags: pa.Table) -> pa.Table:
        table, texts = packed.sorted_texts(table)
        texts = [t.encode() for t in texts]
        repeated = packed.repeated_places(window_numbers(texts, width), flags, buckets)
        counts, spans, kept, at = [], [], [], 0
        for text in texts:
            starts, ends = word_ends(text)
            n = len(starts)
            windows = max(n - width + 1, 0)
            a, b = packed.covered(np.flatnonzero(repeated[at : at + windows]), width, n)
            at += windows
            counts.append(n)
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
            keep, last = [], 0
            for x, y in zip([*a.tolist(), n], [*b.tolist(), n]):
                keep += text[starts[last] : ends[x - 1]].split() if x > last else []
                last = y
            kept.append(b" ".join(keep).decode())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table(
            {"doc_id": table.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.string())}
        )

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, spans array<struct<start:int,end:int>>, kept string"
    return rows.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(remove, schema)

