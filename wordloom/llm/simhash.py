"""SimHash near-duplicates: fingerprints of word shingles, compared as vertical bit planes within candidate bands."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.bounds import settled
from wordloom.llm.common import columns_aside
from wordloom.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
# Fingerprints that one task compares with one another; larger candidate groups are cut into pairs of such blocks.
BLOCK = 2048


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 hashes of all shingles of a text."""
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][: len(words) - shingle + 1]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes.

    Eight passes, each adding one bit of every byte in byte lanes of a word, 255 hashes at a time.
    """
    n, lanes = len(hashes), np.uint64(0x0101010101010101)
    if not n:
        return 0
    result, at = 0, np.arange(0, n, 255)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, at)
        totals = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in range(8):
            if 2 * totals[byte] > n:
                result |= 1 << (8 * byte + bit)
    return result


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The 64 bits of a text as a long.

    A-Z are lower-cased, words are runs of anything but ASCII white space, a text with fewer words than a shingle is one
    shingle, one without words, empty or absent has fingerprint 0. Texts are worked on one by one and whole.
    """

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        values = []
        for text in texts:
            data = text.as_py()
            values.append(majority(shingle_hashes(data.encode().lower().split(), shingle)) if data else 0)
        return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())

    return run(text)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: row i holds bit i of every value."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def within_radius(value: int, planes: np.ndarray, n: int, radius: int) -> np.ndarray:
    """Places of the ``n`` values in the planes that differ from ``value`` in at most ``radius`` bits."""
    return np.flatnonzero(_marked(value, planes, n, radius))


def _marked(value: int, planes: np.ndarray, n: int, radius: int) -> np.ndarray:
    """For each of the ``n`` values in the planes whether it differs from ``value`` in at most ``radius`` bits.

    Differences are added plane by plane in vertical counters: counter bit j of all values is one packed row, and a plane
    is added by a carry that runs through the rows (half adders). What leaves the highest row has passed the radius for
    good. Every eight planes the block is given up when no value is still within.
    """
    height = max(radius.bit_length(), 1)
    counters = [np.zeros(planes.shape[1], np.uint8) for _ in range(height)]
    out = np.zeros(planes.shape[1], np.uint8)
    for i in range(64):
        carry = ~planes[i] if value >> i & 1 else planes[i].copy()
        for j in range(height):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        out |= carry
        if i % 8 == 7:
            beyond = out | _above(counters, radius)
            if beyond.all() and (beyond == 255).all():
                return np.zeros(n, bool)
    beyond = out | _above(counters, radius)
    return np.unpackbits(~beyond, bitorder="little")[:n].astype(bool)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Packed bits of the values whose counter is larger than the radius."""
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], 255)
    for j in reversed(range(len(counters))):
        if radius >> j & 1:
            equal &= counters[j]
        else:
            more |= equal & counters[j]
            equal &= ~counters[j]
    return more


def bands(n: int, radius: int, per_band: float = 4.0) -> list[list[int]]:
    """Sets of bits such that two values within the radius agree on one set at least.

    64 bits are cut into radius + s parts; at most ``radius`` of them differ, so some s parts agree. The number of
    parts grows with the number of values until a set names about ``per_band`` evenly spread values. Results do not
    depend on it.
    """
    for s in range(1, 9):
        if 64 * s / (radius + s) >= math.log2(max(n, 2) / per_band) or s == 8:
            break
    edges = [round(64 * i / (radius + s)) for i in range(radius + s + 1)]
    parts = [list(range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(chosen, []) for chosen in itertools.combinations(parts, s)]


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Whether left[i] and right[i] are within the radius: planes of the differences, counted as in ``within_radius``."""
    return _marked(0, bit_planes(left ^ right), len(left), radius)


class Forest:
    """Keeps the links that join two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def block_links(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block (``right`` empty) or between two blocks."""
    values = np.concatenate([left, right])
    shift = len(left) if len(right) else 0
    others = right if len(right) else left
    planes, forest, found = bit_planes(others), Forest(len(values)), []
    for i, value in enumerate(left.tolist()):
        for j in np.flatnonzero(_marked(value, planes, len(others), radius)) + shift:
            if forest.join(i, int(j)):
                found.append((values[i], values[j]))
    return found


def many_links(values: np.ndarray, ends: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within many small groups; ``ends[i]`` is the end of value i's group.

    Values are compared with the next one of their group, then the one after it, and so on, all groups at once.
    """
    forest, found, at, step = Forest(len(values)), [], np.arange(len(values)), 1
    while True:
        at = at[at + step < ends[at]]
        if not len(at):
            return found
        for i in at[close_pairs(values[at], values[at + step], radius)].tolist():
            if forest.join(i, i + step):
                found.append((values[i], values[i + step]))
        step += 1


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (one column ``fingerprint``) that connect all within the radius.

    Values that agree on a band are one candidate group; a group is cut into blocks by hash, every pair of blocks is one
    task's group, and each gives a spanning forest of its links, so the output is at most one row per value and group.
    """
    prints = settled(prints)
    sets = bands(prints.count(), radius)
    masks = []
    for chosen in sets:
        mask = sum(1 << i for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    numbered = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])
    rows = prints.select("fingerprint", F.explode(numbered).alias("k")).select("fingerprint", "k.band", "k.part")
    sizes = rows.groupBy("band", "part").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("held") / block).cast("int")).drop("held")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    cut = rows.join(sizes, ["band", "part"]).withColumn("own", own)
    # Block i meets every block j >= i: each row goes to its pairs with all blocks.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")),
    )
    spread = cut.withColumn("p", F.explode(pairs)).select("band", "part", "p.i", "p.j", "own", "fingerprint")
    group = ["band", "part", "i", "j"]
    dealt = spread.repartition(*group).sortWithinPartitions(*group, "own", "fingerprint")

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = table if held is None else pa.concat_tables([held, table])
            keys = [rows.column(c).to_numpy() for c in group]
            starts = _starts(keys)
            # The last group may go on in the next batch.
            yield _linked(rows.slice(0, starts[-1]), starts, keys, radius)
            held = rows.slice(starts[-1]).combine_chunks()
        if held is not None:
            keys = [held.column(c).to_numpy() for c in group]
            yield _linked(held, np.append(_starts(keys), held.num_rows), keys, radius)

    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Places at which a new group begins in sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _linked(rows: pa.Table, starts: np.ndarray, keys: list[np.ndarray], radius: int, small: int = 64) -> pa.RecordBatch:
    """The links of whole groups, which begin at all but the last of ``starts``; the last is the end of the rows."""
    values, own = rows.column("fingerprint").to_numpy().view(np.uint64), rows.column("own").to_numpy()
    sizes, links = np.diff(starts), []
    few = (sizes <= small) & (keys[2][starts[:-1]] == keys[3][starts[:-1]])
    at = np.repeat(few, sizes)
    if at.any():
        ends = np.cumsum(sizes[few])
        links += many_links(values[at], np.repeat(ends, sizes[few]), radius)
    for start, size in zip(starts[:-1][~few].tolist(), sizes[~few].tolist()):
        chosen, blocks = values[start : start + size], own[start : start + size]
        i, j = keys[2][start], keys[3][start]
        left, right = chosen[blocks == i], chosen[blocks == j] if i != j else chosen[:0]
        if len(left) and (len(right) or i == j):
            links += block_links(left, right, radius)
    ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK, carry: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, fingerprint, component, component_id`` per row of ``docs``: the smallest fingerprint and the smallest
    doc_id reachable over links, its own included.

    Documents link when their fingerprints differ in at most ``radius`` bits; equal fingerprints are one node, so copies
    are never paired. Absent, empty and wordless texts share fingerprint 0 and link like any other; an absent doc_id is
    no candidate for the smallest (a component without ids has none); repeated rows are kept; an empty table gives no
    rows. ``carry`` names further values to take along from each row.
    """
    more = [c.alias(name) for name, c in (carry or {}).items()]
    marked = settled(docs.select("doc_id", fingerprint_column(F.col("text").cast("string"), shingle).alias("fingerprint"), *more))
    nodes = settled(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    found = components(fingerprint_links(nodes.select("fingerprint"), radius, block))
    placed = nodes.join(found, F.col("fingerprint") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.select(F.col("fingerprint").alias("_print"), "component").join(least, "component")
    return marked.join(named, F.col("fingerprint") == F.col("_print")).drop("_print")


@columns_aside
def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One document of each component with the columns of ``docs``: the one with the smallest doc_id.

    Among rows of that id the smallest hash of the whole row stays, of equal rows one. A component without ids keeps
    its row of smallest hash. Columns of any name pass through. An empty table gives no rows.
    """
    whole = F.xxhash64(*docs.columns)
    rows = near_duplicates(docs, shingle, radius, block, {"_row": whole})
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_row"))).alias("first")
    chosen = rows.groupBy("component").agg(first).select(F.col("first.doc_id").alias("_id"), "first._row")
    counts = rows.groupBy(F.col("doc_id").alias("_id"), "_row").agg(F.count(F.lit(1)).alias("_equal"))
    chosen = settled(chosen.join(counts, chosen["_id"].eqNullSafe(counts["_id"]) & (chosen["_row"] == counts["_row"])).select(chosen["_id"], chosen["_row"], "_equal"))
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_id"]) & (whole == chosen["_row"]))
    single = kept.filter("_equal = 1").select(*docs.columns)
    repeated = kept.filter("_equal > 1").dropDuplicates(["_id", "_row"]).select(*docs.columns)
    return single.unionByName(repeated)
