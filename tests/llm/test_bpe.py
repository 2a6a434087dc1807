"""The transducer against the tokenizers library, the lookahead against the longest possible windows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.llm import bpe, queries

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, ids string, tokens int"


@pytest.fixture(scope="module")
def library():
    lib = tokenizers.Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    return lib


def ours(texts):
    return [np.frombuffer(b, np.int32) for b in bpe.tokenizer(PATH).encode(texts)]


def check(texts, library):
    tok = bpe.tokenizer(PATH)
    for text, ids in zip(texts, ours(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text[:200]
        assert tok.decode(ids) == library.decode(want, skip_special_tokens=False)


FIXED = [
    "", " ", "Hello, World's 123 test!!", "ΑΣ ΣΑΣ. İstanbul ǅ é é", "a\x1cb c\x85d\xa0e f　g\x0b\x0c\x1d", "it's we'll I'M ' 's 'S 've",
    "<|endoftext|>x<|startoftext|> <|endoftext|", "日本語テキスト😀😀 ﷺ ½ Ⅷ ³ ١٢", "a" * 9000, "ab" * 6000 + "é" * 3000, "!?" * 5000, "1234567890" * 500,
    "x̧́ý̧", "﻿​­", "the quick brown fox " * 50, "͸\U000f0000",
]


def test_fixed_texts(library):
    check(FIXED, library)
    random.seed(4)
    syllables = "the ing er on an re ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
    check(["".join(random.choices(syllables, k=4000)) for _ in range(6)], library)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    check([text, text + " " + text.upper()], library)


def test_every_window_gives_the_same(library, monkeypatch):
    tok = bpe.tokenizer(PATH)
    random.seed(8)
    words = ["".join(random.choices("aetoinshrdl", k=5000)) for _ in range(4)] + ["th" * 3000, "hahaha" * 900, "e" * 5000]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    for extra in (int(tok.lengths.max()) + 1, 500, 10**6):
        monkeypatch.setattr(tok, "window", tok.lookahead + extra)
        assert [np.frombuffer(b, np.int32).tolist() for b in tok.encode_words([w.encode() for w in words])] == want


def test_lookahead_by_hand():
    assert bpe.sufficient_lookahead([]) == 0
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    # bc first, then ab: a border moved over b lets a see another neighbour.
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2
    assert bpe.sufficient_lookahead([("a", "b"), ("b", "c")]) == 1


def test_pieces_and_bounded_table(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 20)
    tok = bpe.tokenizer(PATH)
    monkeypatch.setattr(tok, "known", {})
    check([f"word{i} and more text number {i} <|endoftext|> end " * 20 for i in range(8)] + FIXED, library)
    assert len(tok.known) <= 60


def test_byte_decoder():
    tok = bpe.Tokenizer.__new__(bpe.Tokenizer)
    letters = bpe.byte_letters()
    assert len(set(letters)) == 256
    tok.byte_decoder, tok.special, tok.tokens = True, {"<s>": 256}, [*letters, "<s>"]
    tok._prepare_decoding(letters)
    data = "héllo 😀".encode()
    assert tok.decode(np.frombuffer(data, np.uint8).astype(np.int32), 1) == "héllo 😀"
    assert tok.decode(np.array([0xF0, 0x9F, 256, 0xE2, 0x28]), 2) == "�<s>�("


def test_query(spark, tmp_path, library):
    docs = [(i, t, "en", "x", 1) for i, t in enumerate(FIXED + [None, "long text " * 60000])] + [(None, "hello", None, None, None)] * 2
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d in docs:
        ids = library.encode(d[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op7_bpe(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    apart = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted(map(str, apart)) == sorted(map(str, bpe.round_trip(df, PATH).collect()))
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.decode(bpe.encode(empty, PATH), PATH).collect() == []
