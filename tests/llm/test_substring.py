"""Repeated windows of words against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from wordloom.llm import packed, queries, substring

SCHEMA = "doc_id long, text string, lang string, chunk int, bucket string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(width)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "日本", "a", "😀"]
    passage = r.choices(vocabulary, k=60)
    texts = [None, "", " \n ", "one", " ".join(passage), " ".join(passage[:35]), " ".join(passage[:34])]
    for i in range(40):
        body = r.choices(vocabulary, k=r.randint(1, 300))
        if i % 3 == 0:
            a = r.randint(0, 30)
            at = r.randint(0, len(body))
            body[at:at] = passage[a : a + r.randint(20, 60)]
        texts.append(r.choice([" ", "\n", "\t  "]).join(body))
    return texts + [texts[10]] * 3 + [" ".join(["same"] * 200), " ".join(f"x{i}" for i in range(30000)) + " " + " ".join(passage)]


@pytest.mark.parametrize("chunk_bytes, width", [(10**9, 35), (3000, 35), (3000, 3), (700, 1)])
def test_removal(spark, monkeypatch, chunk_bytes, width):
    monkeypatch.setattr(packed.in_chunks, "__defaults__", (chunk_bytes,))
    monkeypatch.setattr(packed, "BUCKET_NUMBERS", 5000)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "en", 1, "x", 2) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in substring.without_repeats(df, width).collect()}
    want = plain(texts, width)
    assert len(got) == len(texts)
    for i, (n, gone, kept) in enumerate(want):
        r = got[i]
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) == (n, gone, kept)
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_query_and_equal_rows(spark, tmp_path):
    texts = corpus(2)
    rows = [(i, t, "en", 1, "x", 2) for i, t in enumerate(texts)] + [(None, texts[12], None, None, None, None)] * 2 + [(3, texts[3], None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op4_substring(spark, str(tmp_path)).collect()), key=str)
    want = plain([r[1] for r in rows], 35)
    assert got == sorted(((r[0], n, gone, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, gone, kept) in zip(rows, want)), key=str)


def test_words_and_rolling_hashes():
    text = "é a\tb\x0b\x0cc  日本 \x1cd "
    starts, ends = substring.word_ends(text.encode())
    assert [text.encode()[a:b].decode() for a, b in zip(starts, ends)] == WORD.findall(text)
    values = np.arange(1, 200, dtype=np.uint64)
    for width in (1, 2, 3, 7, 35, 64):
        windows = packed.rolling(np.tile(values, 2), width)
        assert len(windows) == 399 - width and len(set(windows.tolist())) == min(199, 399 - width)
        assert packed.rolling(values[: width - 1], width).tolist() == []
    long = ("word " * 10 + "x" * 50) * 3
    starts, ends = substring.word_ends(long.encode())
    whole = substring.word_numbers(long.encode(), starts, ends)
    assert len(set(whole.tolist())) == len({long[a:b] for a, b in zip(starts, ends)})


def test_empty(spark):
    assert substring.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
