"""Trees, proofs and trials against a plain recomputation."""

import hashlib
import os
import zlib

import pytest

from wordloom.llm import merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, path int, digest string"
TO_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def measured(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc, text):
    return h(*map(measured, (*doc[:4], text)))


def grown(nodes):
    """The top of a list of digests and each one's siblings, as pairs of texts, from the bottom to the top."""
    paths, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for path, p in zip(paths, place):
            first = p // 16 * 16
            path.append(("".join(level[first:p]), "".join(level[p + 1 : first + 16])))
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        place = [p // 16 for p in place]
    return (level[0] if level else None), paths


def expected(docs):
    sources = sorted({d[1] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    per, subroots = {}, []
    for s in sources:
        own = sorted((d for d in docs if d[1] == s), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[4])))
        top, paths = grown([leaf(d, d[4]) for d in own])
        per[s] = (own, paths)
        subroots.append(top)
    root, high = grown(subroots)
    rows = []
    for s, subroot, rest in zip(sources, subroots, high):
        for d, path in zip(*per[s]):
            path, own = path + rest, leaf(d, d[4])
            node = own
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[4] is not None:
                node = leaf(d, d[4].translate(TO_SMALL))
            for before, after in path:
                node = h(before, node, after)
            rows.append((d[0], own, subroot, root, h(*[a + b for a, b in path]), node, node == root))
    return sorted(rows, key=str)


def got(frame):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def docs(count, source="s"):
    return [(i, source, "en", 3, f"Text {i}", "t", 1, "d") for i in range(count)]


def test_sizes_of_trees(spark):
    rows = [d for count in (1, 2, 15, 16, 17, 256, 257, 4097) for d in docs(count, f"of {count}")]
    assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


@pytest.mark.parametrize("count", [1, 18])
def test_one_source(spark, count):
    rows = docs(count)
    assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_sources_and_edge_rows(spark):
    rows = [d for n in range(40) for d in docs(1 + n % 19, f"source {n}")]
    rows += docs(300, None) + docs(3, "") + docs(2, "é") + docs(2, "Z")
    rows += [(None, None, None, None, None, None, None, None)] * 3 + [(7, "rep", "en", 1, "Same", "", 0, "")] * 40
    rows += [(10**6 + i, "s", None, -i, "", "x", 2, "y") for i in range(30)] + [(5, "long", "en", 1, "Very Long 𝄞 " * 100_000, "", 0, "")]
    frame = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got(frame) == expected(rows)
    tampered = [r for r in frame.collect() if not r["verified"]]
    assert tampered and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in tampered)


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got(merkle.manifest(table)) == expected(rows)
