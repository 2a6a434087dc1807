"""Hilbert order and the even cut."""

import itertools
import math
import zlib

import pytest

from wordloom.llm import sharding
from wordloom.llm.queries import op9_sharding

SCHEMA = "doc_id long, text string, lang string, source string, size string, hilbert int"


@pytest.mark.parametrize("dimensions, bits", [(2, 3), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, dimensions, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dimensions))
    names = [f"d{i}" for i in range(dimensions)]
    df = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names))
    rows = sorted(sharding.hilbert_index(df, names, "h", bits).collect(), key=lambda r: r["h"])
    assert [r["h"] for r in rows] == list(range(len(cells)))
    assert all(sum(abs(a[n] - b[n]) for n in names) == 1 for a, b in zip(rows, rows[1:]))


def check(rows, docs, shards=16):
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None)
    want = sorted((True, d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs if d[0] is not None)
    assert got == want and len(rows) == len(docs)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_edge_rows(spark):
    docs = [(i % 7, t, lang, s, "x", 1) for i, (t, lang, s) in enumerate(itertools.product(["a b", "", None, "é" * 3000], ["en", None], ["s", "", None]))]
    docs += [(None, None, None, None, None, None)] * 2 + [(1, "same", "en", "s", "y", 2)] * 30
    check(sharding.shard(spark.createDataFrame(docs, SCHEMA)).collect(), docs)
    few = docs[:5]
    check(sharding.shard(spark.createDataFrame(few, SCHEMA)).collect(), few)
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []


def curve_place(point, bits):
    """Place of a cell on the curve, one bit of every dimension at a time, highest first."""
    n = len(point)
    mask = (1 << n) - 1
    turned = lambda x, by: ((x << by % n) | (x >> (n - by % n))) & mask
    trailing_ones = lambda x: len(bin(x)) - len(bin(x).rstrip("1"))
    entry, axis, place = 0, 0, 0
    for b in reversed(range(bits)):
        corner = sum((c >> b & 1) << i for i, c in enumerate(point)) ^ entry
        gray = turned(corner, n - (axis + 1) % n)
        rank = 0
        while gray:
            rank, gray = rank ^ gray, gray >> 1
        before = 2 * ((rank - 1) // 2) if rank else 0
        entry ^= turned(before ^ before >> 1, axis + 1)
        axis = (axis + (trailing_ones(rank if rank % 2 else rank - 1) if rank else 0) + 1) % n
        place = place << n | rank
    return place


def dealt(docs, shards=16, bits=8):
    """Rows of the operator in plain Python: ``doc_id, size, checksum, place on the curve, shard, slot``."""
    top = 1 << bits
    ids = [d["doc_id"] for d in docs]
    low, high = min(ids), max(ids)
    names = {c: sorted({d[c] for d in docs if d[c] is not None}) for c in ("source", "lang")}
    cell = lambda c, v: 0 if v is None else names[c].index(v) * top // len(names[c])
    rows = []
    for d in docs:
        data = (d["text"] or "").encode()
        size = min(top - 1, math.floor(math.log2(len(data) + 1) * ((top - 1) / 40)))
        point = [cell("source", d["source"]), cell("lang", d["lang"]), size, (d["doc_id"] - low) * top // (high - low + 1)]
        rows.append((curve_place(point, bits), d["doc_id"], zlib.crc32(data), len(data) + 1))
    rows.sort()
    runs = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    places = [(s, slot) for s, length in enumerate(runs) for slot in range(length)]
    return sorted((i, size, crc, h, s, slot) for (h, i, crc, size), (s, slot) in zip(rows, places))


def test_query_equals_plain_python_and_shards_prune(spark):
    folder = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "text").collect()]
    got = op9_sharding(spark, folder)
    assert got.filter("law <> 'rows' or grown_shard is not null").count() == 0
    rows = [tuple(r) for r in got.select("doc_id", "size", "text_crc32", "hilbert", "shard", "slot").collect()]
    assert sorted(rows) == dealt(docs)
    # Shards that a filter on one value must open: all 16 where rows are dealt by hash, fewer along the curve.
    shard = {r[0]: r[4] for r in rows}
    for column in ("source", "lang"):
        opened = {}
        for d in docs:
            opened.setdefault(d[column], set()).add(shard[d["doc_id"]])
        held = [len(opened[d[column]]) for d in docs]
        by_hash = {}
        for d in docs:
            by_hash.setdefault(d[column], set()).add(zlib.crc32(str(d["doc_id"]).encode()) % 16)
        assert sum(held) < 0.8 * sum(len(by_hash[d[column]]) for d in docs), column


def test_few_rows_equal_plain_python(spark):
    docs = [{"doc_id": 10 * i, "text": "é" * i, "lang": None if i % 3 else "en", "source": ["b", None, "a"][i % 3]} for i in range(1, 8)]
    table = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], "x", 1) for d in docs], SCHEMA)
    rows = sharding.shard(table).select("doc_id", "size", "text_crc32", "hilbert", "shard", "slot").collect()
    assert sorted(tuple(r) for r in rows) == dealt(docs)
