"""Grammars, their files, and the ids of the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.llm import queries, repair

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, part int, block string, ids int"


@pytest.fixture(scope="module")
def library():
    lib = tokenizers.Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    return lib


@pytest.fixture(scope="module")
def encode():
    return repair.library_encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("aé .,'\n\t st19#\x85\xa0<|endoftext|>ß\x0b\x0c\x1f", max_size=80))
def test_ids(library, encode, text):
    assert [i.tolist() for i in encode([text])] == [library.encode(text, add_special_tokens=False).ids]


@settings(max_examples=500, deadline=None)
@given(st.text("aé' \n\t\r\x0b\x0c\x85\xa0\x00\x1b\x1c7.", max_size=60))
def test_ids_around_blanks(library, encode, text):
    assert [i.tolist() for i in encode([text, "", text + "x"])] == [library.encode(t, add_special_tokens=False).ids for t in (text, "", text + "x")]


def test_split_does_not_look_ahead(monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    given_to, plain = [], tiktoken.Encoding.__init__
    monkeypatch.setattr(tiktoken.Encoding, "__init__", lambda self, *a, **k: given_to.append(k["pat_str"]) or plain(self, *a, **k))
    ids = next(repair.library_encoder(PATH)(pa.array(["no  looking ahead"])))
    assert len(given_to) == 1 and "(?" not in given_to[0] and ids.dtype == np.uint32


@pytest.mark.parametrize("most", [3, 1 << 40])
def test_ranks_follow_counts(most):
    r = np.random.default_rng(5)
    counts, kinds = r.integers(2, most, 5000, endpoint=True), r.permutation(np.arange(5000, dtype=np.uint64))
    ranked = repair._ranked(counts, kinds)
    assert sorted(ranked.tolist()) == list(range(5000)) and (np.diff(counts[ranked]) >= 0).all()


@pytest.mark.parametrize("ids", [[2], [5, 2], [7] * 1001 + [2], [1, 2] * 500, random.Random(1).choices(range(50_000), k=3000) + [2]])
def test_grammar(ids):
    data = np.array(ids, np.uint32)
    grammar = repair.compress(data)
    assert repair.expand(grammar).tolist() == ids
    through = np.cumsum(grammar["lengths"][grammar["body"]])
    assert set((np.flatnonzero(data == 2) + 1).tolist()) <= set(through.tolist())


def test_grammar_is_smaller_and_read_in_parts():
    r = random.Random(3)
    phrases = [[r.randrange(3, 40_000) for _ in range(12)] for _ in range(40)]
    ids = [i for _ in range(2000) for i in r.choice(phrases)] + [2]
    grammar = repair.compress(np.array(ids, np.uint32))
    assert len(grammar["body"]) < len(ids) / 3 and len(grammar["lengths"]) == len(grammar["terminals"]) + len(grammar["rules"])
    through = np.concatenate([[0], np.cumsum(grammar["lengths"][grammar["body"]])])
    assert repair.expand(grammar, 100, 300).tolist() == ids[through[100] : through[300]]


def repeated(grammar, end=2):
    """Pairs of the body that may be replaced and occur twice without overlap."""
    table, starts = repair.expansions(grammar)
    body, last, seen, out = grammar["body"].tolist(), (starts + grammar["lengths"] - 1).tolist(), {}, set()
    for i, pair in enumerate(zip(body, body[1:])):
        if table[last[pair[0]]] != end and seen.setdefault(pair, i) < i - 1:
            out.add(pair)
    return out


R = random.Random(5)
PASSAGE = [R.randrange(3, 40_000) for _ in range(1000)]
FEW = [R.randrange(3, 30) for _ in range(5000)]
WIDE = [i for _ in range(2) for i in range(3, 50_000) for i in (i, 3)]


@pytest.mark.parametrize("ids", [[*PASSAGE, 2] * 60, [1, 2] * 500, [7] * 1001 + [2], [3, 4, 9, 3, 4, 2], [*range(3, 1000), 2] * 3, FEW, [*FEW, 2] * 3, WIDE])
def test_no_pair_is_left_twice(ids):
    grammar = repair.compress(np.array(ids, np.uint32))
    assert repair.expand(grammar).tolist() == ids
    assert not repeated(grammar)
    if ids[:1000] == PASSAGE:
        assert len(grammar["body"]) == 60
    if ids is WIDE:
        assert len(grammar["lengths"]) > repair.NUMBERS
        schema = pa.schema([(n, pa.int64()) for n in ("part", "block", "first_id", "last_id", "n_ids")] + [("doc_ids", pa.list_(pa.int64()))])
        for n in ("doc_numbers", "doc_lengths", "terminals", "rules", "lengths", "body"):
            schema = schema.append(pa.field(n, pa.binary()))
        row = repair._block(0, 0, pa.array([1]), [np.array(ids, np.uint32)], schema).to_pylist()[0]
        assert repair.expand(repair._grammar(row)).tolist() == ids


def test_more_ids_than_16_bits():
    ids = [*range(3, 80_000), 2] * 2
    grammar = repair.compress(np.array(ids, np.uint32))
    assert len(grammar["terminals"]) > repair.NUMBERS and repair.expand(grammar).tolist() == ids and len(grammar["body"]) == 2


TEXTS = [None, "", " ", "a", "Some text. " * 40, "日本語 😀", "<|endoftext|> end", "long words here " * 20000, "x" * 2000, "é\n\n  é"]


@pytest.mark.parametrize("block_ids", [1_000_000, 60])
def test_files(spark, tmp_path, library, monkeypatch, block_ids):
    docs = [(50 - i, t, "en", 1, "x", 2) for i, t in enumerate(TEXTS)] + [(100 + i, f"number {i} of many " * (i % 5), None, None, None, None) for i in range(40)]
    docs += [(None, "no id", None, None, None, None)] * 2 + [(50, "same id", None, None, None, None)]
    random.Random(2).shuffle(docs)
    df = spark.createDataFrame(docs, SCHEMA)
    path = f"{tmp_path}/ids"
    repair.write_ids(df, PATH, path, block_ids=block_ids)
    ids = {t: [*library.encode(t, add_special_tokens=False).ids, 2] for t in {d[1] or "" for d in docs}}
    got = repair.read_ids(spark, path).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(d[0]), ids[d[1] or ""]) for d in docs)
    one = repair.read_ids(spark, path, [43, 120]).collect()
    assert {r["doc_id"]: r["ids"] for r in one} == {d[0]: ids[d[1] or ""] for d in docs if d[0] in (43, 120)}
    rows = sorted(repair.summaries(spark, path).collect(), key=lambda r: r["start"])
    start, last = 0, -1
    left = [(d[0], ids[d[1] or ""]) for d in docs]
    for r in rows:
        assert r["start"] == start and (r["doc_id"] is None or r["doc_id"] >= last)
        found = next(x for x in left if x[0] == r["doc_id"] and zlib.crc32(np.array(x[1], "<u4").tobytes()) == r["ids_crc32"] and len(x[1]) == r["n_tokens"])
        left.remove(found)
        start, last = start + r["n_tokens"], 10**9 if r["doc_id"] is None else r["doc_id"]
    assert not left


def test_query_and_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op10_repair(spark, str(tmp_path)).collect() == []
