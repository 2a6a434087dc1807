"""Suffix-array dedup: byte strings that occur twice, by suffix arrays of shards and merging of their distinct strings."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm import packed
from wordloom.llm.substring import ODD
from wordloom.llm.substring import word_numbers as range_numbers

WIDTH = 400
SHARD_BYTES = 4_000_000
# Bytes of the short strings whose hashes choose anchors.
GRAM = 16
# Bytes worked on at a time where an array has one number per byte, and the longest width.
STRETCH = 250_000
MOST_WIDTH = 100_000


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a byte array in the order of what follows them, compared over at least ``depth`` bytes.

    Larsson and Sadakane: places are sorted by their first 8 bytes; then each group of equal ones is sorted by the rank
    of the place as far on as the order already reaches, which doubles the reach. Groups of one are left alone. Groups
    still equal at ``depth`` are in order of place. Behind the end of the text zero bytes are read.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = padded[:n].copy()
    for i in range(1, 8):
        key = (key << np.uint64(8)) | padded[i : n + i]
    order = np.argsort(key)
    key = key[order]
    # The rank of a group is the place of its first member in the order; past the end ranks lowest, with 0.
    first = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    del key, padded
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) + 1
    reach = 8
    alone = first & np.concatenate([first[1:], [True]]) if n else first
    active = np.flatnonzero(~alone)
    while len(active) and reach < depth:
        places = order[active]
        far = rank[np.minimum(places + reach, n)]
        both = rank[places] * (n + 2) + far
        by = np.argsort(both)
        places, both = places[by], both[by]
        order[active] = places
        first = np.concatenate([[True], both[1:] != both[:-1]])
        rank[places] = np.maximum.accumulate(np.where(first, active, 0)) + 1
        alone = first & np.concatenate([first[1:], [True]])
        active = active[~alone]
        reach *= 2
    # By place, equal ones of one string follow those of the string that starts one further on.
    places = order[active]
    order[active] = places[np.argsort(rank[places] * (n + 1) + places)]
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, enough: int) -> np.ndarray:
    """Bytes that each place of ``order`` shares with the one before it there, 0 for the first; from ``enough`` on a
    smaller number may be given, but none below ``enough``.

    Kasai's rule, read by place: where a place's forerunner in the order is one further on than that of the place
    before it, and those two share a byte, the common prefix is one shorter. Only the other places are compared, eight
    bytes at a time, as far as those that follow from them need it.
    """
    m, n = len(order), len(text)
    if m < 2:
        return np.zeros(m, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    places = np.flatnonzero(before >= 0)
    others = before[places]
    follows = np.zeros(len(places), bool)
    follows[1:] = (places[1:] == places[:-1] + 1) & (others[1:] == others[:-1] + 1) & (text[places[:-1]] == text[others[:-1]])
    heads = np.flatnonzero(~follows)
    behind = np.diff(np.append(heads, len(places)))
    length = _shared(text, places[heads], others[heads], enough + behind)
    run = np.cumsum(~follows) - 1
    shared = np.zeros(n, np.int64)
    shared[places] = length[run] - (places - places[heads][run])
    out = shared[order]
    out[0] = 0
    return out


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of places, given up when they reach ``most``."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    # The eight bytes at every place as one number, the first byte being the lowest.
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    length, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        differ = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
        # The lowest set bit shows the first differing byte; behind the end of the text nothing is shared.
        equal = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        step = np.minimum(equal, np.maximum(np.minimum(n - x, n - y), 0))
        length[live] += step
        live = live[(step == 8) & (length[live] < most[live])]
    return length


def _window_best(values: np.ndarray, width: int, best) -> np.ndarray:
    """The best value of every window, by windows of 1, 2, 4 ... and one overlap."""
    part, size = values, 1
    while 2 * size <= width:
        part = best(part[:-size], part[size:])
        size *= 2
    rest = width - size
    return best(part[: len(part) - rest], part[rest:]) if rest else part


def anchors(data: np.ndarray, span: int) -> np.ndarray:
    """Places whose short string has the smallest hash among some ``span`` places in a row.

    Equal strings that hold ``span`` such places have their anchors at equal places; 32-bit hashes do, as equal ones
    only bring more anchors. The data is taken in stretches that overlap by what an anchor depends on.
    """
    out = []
    for a in range(0, len(data), STRETCH):
        low, high = max(0, a - span), min(len(data), a + STRETCH + span + GRAM)
        hashes = data[low:high].astype(np.uint32)
        size, power = 1, 0x9E3779B1
        while size < GRAM:
            hashes = hashes[:-size] + hashes[size:] * np.uint32(power)
            size, power = 2 * size, power * power % (1 << 32)
        if len(hashes) < span:
            continue
        hashes = (hashes ^ (hashes >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        least = _window_best(hashes, span, np.minimum)
        edge = np.zeros(span - 1, np.uint32)
        most = _window_best(np.concatenate([edge, least, edge]), span, np.maximum)
        at = np.flatnonzero(most == hashes) + low
        out.append(at[(at >= a) & (at < a + STRETCH)])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@functools.cache
def _powers(base: int) -> np.ndarray:
    out = np.full(STRETCH + MOST_WIDTH, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def string_numbers(data: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of the strings of ``width`` bytes at all places, by running sums."""
    out, odd = np.zeros(max(len(data) - width + 1, 0), np.uint64), ODD
    for a in range(0, len(out), STRETCH):
        part = data[a : a + STRETCH + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(odd)[: len(part)], out=sums[1:])
        n = len(part) - width + 1
        out[a : a + n] = (sums[width:] - sums[:n]) * _powers(pow(odd, -1, 1 << 64))[:n]
    return out


class Shard:
    """A chunk's texts as one byte string, with the end of each place's text."""

    def __init__(self, table: pa.Table, width: int):
        self.table, texts = packed.sorted_texts(table)
        texts = [t.encode() for t in texts]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = b"".join(texts)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.width = width
        # Half of the string's places choose an anchor, the other half follows it and is compared.
        self.span = max(1, (width - GRAM) // 2)
        self.core = width - self.span + 1

    def cores(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchors of all texts of at least ``width`` bytes and the hashes of the bytes that follow them."""
        at = anchors(self.bytes, self.span)
        text = np.searchsorted(self.ends, at, "right")
        at = at[(self.sizes[text] >= self.width) & (at + self.core <= self.ends[text])]
        return at, range_numbers(self.data, at, at + self.core)

    def starts_near(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of starts, ends exclusive, of strings that choose one of these anchors."""
        text = np.searchsorted(self.ends, at, "right")
        low = np.maximum(at - self.span + 1, self.ends[text] - self.sizes[text])
        high = np.minimum(at + 1, self.ends[text] - self.width + 1)
        low, high = low[low < high], high[low < high]
        if not len(low):
            return low, high
        new = (low[1:] > high[:-1]) | (np.searchsorted(self.ends, low[1:], "right") != np.searchsorted(self.ends, low[:-1], "right"))
        cut = np.flatnonzero(new)
        return low[np.concatenate([[0], cut + 1])], high[np.concatenate([cut, [len(high) - 1]])]


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of runs."""
    sizes = high - low
    return np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers as runs, ends exclusive."""
    cut = np.flatnonzero(np.diff(at) != 1)
    if not len(at):
        return at, at
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1


def _noted(*arrays: np.ndarray) -> bytes:
    return b"".join(len(a).to_bytes(8, "little") + a.astype("<i8").tobytes() for a in arrays)


def _read_notes(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(data, "<i8", n, at + 8))
        at += 8 + 8 * n
    return out


class Strings:
    """The strings that start in runs of places: the runs' bytes put together, with where each start came from."""

    def __init__(self, shard: Shard, low: np.ndarray, high: np.ndarray):
        self.width = shard.width
        self.text = shard.bytes[_spread(low, high + self.width - 1)]
        sizes = high - low + self.width - 1
        base = np.cumsum(sizes) - sizes
        self.is_start = np.zeros(len(self.text), bool)
        self.is_start[_spread(base, base + (high - low))] = True
        self.starts = _spread(low, high)

    def numbers(self) -> np.ndarray:
        """The hash of each start's string."""
        return string_numbers(self.text, self.width)[self.is_start[: len(self.text) - self.width + 1]]

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """By start: whether it stands for its string (one start does), and whether the shard has its string twice.

        From the suffix array and the common prefixes: starts follow one another in it, and strings are equal exactly
        where the common prefix is at least as long as they are.
        """
        order = suffix_array(self.text, self.width)
        order = order[self.is_start[order]]
        as_before = common_prefixes(self.text, order, self.width) >= self.width
        twice = as_before.copy()
        twice[:-1] |= as_before[1:]
        number = np.cumsum(self.is_start) - 1
        one_each, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
        one_each[number[order[~as_before]]] = True
        again[number[order[twice]]] = True
        return one_each, again


def without_repeats(docs: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: maximal removed runs of UTF-8 bytes, ends exclusive, and the bytes left.

    A byte is removed when a string of ``width`` bytes that covers it starts at another place too, in any document.
    1. Each shard picks anchors by content and asks, in packed hashes, which of the strings behind them occur again
       anywhere; a repeated string has such an anchor at the same place in all its copies, so all else is settled.
    2. The bytes around repeated anchors get a suffix array (Larsson-Sadakane) and common prefixes (Kasai) per
       shard: these give the strings that repeat inside the shard and one start for each distinct string.
    3. Shards are merged: the 64-bit hashes of their distinct strings are sorted runs, cut at common places of the number
       line by binary search; what a run shares with others is found by binary search and sent back as bits.
    Only hashes cross shards, so a passage in a third of all texts is a few entries per shard.

    Absent texts are empty; texts shorter than ``width`` lose nothing; equal rows remove each other; what is left may cut
    characters, so it is binary; an empty table gives no rows; columns beside doc_id and text are not read.
    """
    rows, held = packed.in_chunks(docs, shard_bytes)
    few, many = packed.buckets_for(held // 64), packed.buckets_for(held // 4)

    def cores(table: pa.Table) -> np.ndarray:
        return Shard(table, width).cores()[1]

    repeated = packed.shared_flags(packed.per_chunk(rows, cores, few))

    def distinct(table: pa.Table, flags: pa.Table) -> pa.Table:
        shard, chunk = Shard(table, width), table.column("chunk")[0].as_py()
        at, numbers = shard.cores()
        low, high = shard.starts_near(at[packed.repeated_places(numbers, flags, few)])
        note = pa.table({"chunk": pa.array([chunk], pa.int32()), "bucket": pa.array([-1 - chunk], pa.int32())})
        if not len(low):
            return note.append_column("numbers", pa.array([_noted(low, high, low, high)], pa.binary()))
        strings = Strings(shard, low, high)
        one_each, again = strings.classes()
        note = note.append_column("numbers", pa.array([_noted(low, high, *_runs(strings.starts[again]))], pa.binary()))
        return pa.concat_tables([note, packed.packed_rows(chunk, strings.numbers()[one_each], many)])

    strings = rows.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(distinct, packed.PACKED)
    merged = packed.shared_flags(strings)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        shard = Shard(table, width)
        own = np.array(answers.column("bucket").to_pylist()) < 0
        low, high, low_twice, high_twice = _read_notes(answers.column("flags").to_pylist()[int(np.flatnonzero(own)[0])])
        flags = answers.filter(pa.array(~own))
        gone = np.zeros(len(shard.bytes), bool)
        gone[_spread(low_twice, high_twice)] = True
        if flags.num_rows:
            strings = Strings(shard, low, high)
            numbers = strings.numbers()
            order = np.argsort(numbers)
            numbers = numbers[order]
            first = np.concatenate([[True], numbers[1:] != numbers[:-1]])
            shared = packed.shared_numbers(numbers[first], flags, many)
            gone[strings.starts[order[shared[np.cumsum(first) - 1]]]] = True
        spans, kept = [], []
        for end, size in zip(shard.ends.tolist(), shard.sizes.tolist()):
            start = end - size
            a, b = packed.covered(np.flatnonzero(gone[start:end]), width, size)
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
            edges = [0, *np.stack([a, b], 1).ravel().tolist(), size]
            kept.append(b"".join(shard.data[start + x : start + y] for x, y in zip(edges[::2], edges[1::2])))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table(
            {
                "doc_id": shard.table.column("doc_id"),
                "n_bytes": pa.array(shard.sizes, pa.int64()),
                "spans": pa.array(spans, span),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary"
    return rows.groupBy("chunk").cogroup(merged.groupBy("chunk")).applyInArrow(remove, schema)
