"""Suffix arrays, common prefixes and removed bytes against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wordloom.llm import packed, queries, suffix

SCHEMA = "doc_id long, text string, lang string, chunk int, bucket string, kept int"


def plain(texts, width):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - width + 1):
            if count[d[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0
        out.append((len(d), int(gone.sum()), spans, kept))
    return out


@pytest.mark.parametrize("text", [b"", b"a", b"banana" * 9, bytes(range(256)) * 3, b"a" * 1000, b"\0\0\0a\0" * 40, bytes(random.Random(1).choices(b"ab", k=900))])
def test_suffix_array_and_common_prefixes(text):
    data = np.frombuffer(text, np.uint8)
    order = suffix.suffix_array(data, 2048)
    depth = 8
    assert sorted(order.tolist()) == list(range(len(text)))
    padded = [text[i:] + b"\0" * 8 for i in order.tolist()]
    assert all(a[:depth] <= b[:depth] for a, b in zip(padded, padded[1:]))
    inner = [i for i in order.tolist() if i + 100 <= len(text)]
    assert all(text[a : a + 100] <= text[b : b + 100] for a, b in zip(inner, inner[1:]))
    shared = suffix.common_prefixes(data, order, 10**6)
    capped = suffix.common_prefixes(data, order, 5)
    assert ((capped == shared) | ((capped >= 5) & (shared >= capped))).all()
    for k, (a, b) in enumerate(zip(order.tolist(), order.tolist()[1:]), 1):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert shared[k] == n


def corpus(seed=1):
    r = random.Random(seed)
    letters = "abcdefghij éü日😀\n"
    passage = "".join(r.choices(letters, k=700))
    texts = [None, "", "a", passage, passage[:300], "ab" * 600, "ab" * 450, "z" * 1500, "z" * 399, "z" * 400]
    for i in range(30):
        body = "".join(r.choices(letters, k=r.randint(1, 1500)))
        if i % 3 == 0:
            a, at = r.randint(0, 300), r.randint(0, len(body))
            body = body[:at] + passage[a : a + r.randint(200, 700)] + body[at:]
        texts.append(body)
    return texts + [texts[12]] * 3 + ["".join(r.choices(letters, k=30000)) + passage]


@pytest.mark.parametrize("shard_bytes, width", [(10**9, 400), (4000, 400), (4000, 50), (900, 20)])
def test_removal(spark, monkeypatch, shard_bytes, width):
    monkeypatch.setattr(packed, "BUCKET_NUMBERS", 5000)
    monkeypatch.setattr(suffix, "STRETCH", 5000)
    suffix._powers.cache_clear()
    texts = corpus()
    df = spark.createDataFrame([(i, t, "en", 1, "x", 2) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in suffix.without_repeats(df, width, shard_bytes).collect()}
    for i, (n, gone, spans, kept) in enumerate(plain(texts, width)):
        r = got[i]
        assert (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) == (n, gone, spans, kept), i


def test_query_and_equal_rows(spark, tmp_path):
    texts = corpus(2)
    rows = [(i, t, "en", 1, "x", 2) for i, t in enumerate(texts)] + [(None, texts[12], None, None, None, None)] * 2 + [(2, texts[2], None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op6_suffix_array(spark, str(tmp_path)).collect()), key=str)
    want = [(r[0], n, gone, spans, hashlib.sha256(kept).hexdigest()) for r, (n, gone, spans, kept) in zip(rows, plain([r[1] for r in rows], 400))]
    assert got == sorted(want, key=str)


def test_gap_codes():
    for numbers in ([5], [0, 2**64 - 1], list(range(0, 10**6, 7)), [1, 2**40, 2**63]):
        data = np.array(numbers, np.uint64)
        assert packed.gap_decoded(packed.gap_coded(data)).tolist() == numbers


def test_empty(spark):
    assert suffix.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r["n_bytes"] for r in suffix.without_repeats(spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)).collect()] == [0]
