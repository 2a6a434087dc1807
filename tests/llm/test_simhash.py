"""Fingerprints, bit planes, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from wordloom.llm import components, queries, simhash

SCHEMA = "doc_id long, text string, lang string, fingerprint string, component_id int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text, shingle=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    parts = [" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=4):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_planes(radius):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    values = np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 8), dtype=np.uint64)[:, :k], axis=1) for b in base for k in (1, 3, 5, 8)])
    planes = simhash.bit_planes(values)
    for v in (*base.tolist(), 0, 2**64 - 1):
        want = np.flatnonzero(np.bitwise_count(values ^ np.uint64(v)) <= radius)
        assert simhash.within_radius(v, planes, len(values), radius).tolist() == want.tolist()


@pytest.mark.parametrize("n", [2, 1000, 10**6, 10**10])
def test_bands_meet_within_the_radius(n):
    sets = simhash.bands(n, 4)
    random.seed(n)
    for _ in range(300):
        flipped = set(random.sample(range(64), 4))
        assert any(not flipped & set(chosen) for chosen in sets)


def test_links_join_all_within_the_radius(spark):
    random.seed(5)
    seeds = [random.getrandbits(64) for _ in range(20)]
    values = set(seeds)
    for s in seeds:
        for _ in range(30):
            v = s
            for bit in random.sample(range(64), random.randint(1, 6)):
                v ^= 1 << bit
            values.add(v)
    values |= {0xFFFF_0000_0000_0000 | i for i in range(400)}  # one large group
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint long")
    for block in (16, 2048):
        found = components.components(simhash.fingerprint_links(df, 4, block)).collect()
        names = {r["node"] % 2**64: r["component"] for r in found}
        got = [names.get(v, v) for v in values]
        want = plain_groups(values)
        pairs = set(zip(got, want))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 200)] + [(7, 7), (2000, 2001), (2001, 2000)]
    edges += [(random.randint(3000, 3100), random.randint(3000, 3100)) for _ in range(60)]
    random.shuffle(edges)
    names = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(names[a], names[b])
            changed |= names[a] != least or names[b] != least
            names[a] = names[b] = least
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {n for n in names if all(n not in e or e[0] == e[1] for e in edges)}
    assert got == {n: c for n, c in names.items() if n not in loops}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


random.seed(9)
LONG = [f"word{random.randint(0, 5000)}" for _ in range(30000)]
TEXTS = [None, "", " \n", "one", "One", "a b", "a b c d e f g", "A B c\td\ne f g", "ü É x y z w", " ".join(LONG), " ".join(LONG[:-1]), "rare text of its own " * 3]
TEXTS += [" ".join(["shared"] * 50 + [str(i)]) for i in range(6)]


def test_documents(spark, tmp_path):
    docs = [(100 + i, t, "en", "clash", i) for i, t in enumerate(TEXTS)] + [(5, TEXTS[3], None, None, None)] * 3 + [(None, "no id at all", None, None, None)] * 2
    df = spark.createDataFrame(docs, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op8_simhash(spark, str(tmp_path)).collect()
    prints = [plain_print(d[1]) for d in docs]
    groups = plain_groups(prints)
    least = {}
    for d, g in zip(docs, groups):
        if d[0] is not None:
            least[g] = min(least.get(g, d[0]), d[0])
    want = sorted(((d[0], f"{p:016x}", least.get(g)) for d, p, g in zip(docs, prints, groups)), key=str)
    assert sorted(map(tuple, rows), key=str) == want
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([*least.values(), None], key=str)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.without_near_duplicates(empty).collect() == []
