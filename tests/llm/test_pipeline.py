"""The stages one after the other against plain Python."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from tests.llm import test_mixing, test_pii, test_quality, test_simhash

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("stone", "river", "light", "field", "north") for b in ("ing", "er", "ly", "s", "ed", "ness", "ful", "less")]
    docs = []
    for i in range(60):
        words = r.choices(vocabulary, k=r.randint(60, 200)) if i % 7 else r.choices(vocabulary, k=30)
        if i % 5 == 1:
            words[10:10] = ["Kowalskaja", "writes", "from", "kow@mail.example.org", "daily"]
        if i % 9 == 4:
            words.append("# # # # # # # # # # # # # # # # # # # # # # # # #")
        docs.append((i, " ".join(words), "en", f"s{i % 3}" if i % 4 else None, 0))
    docs += [(100 + i, docs[2][1], "en", "s1", 0) for i in range(5)] + [(200, docs[3][1] + " tail", "en", "s2", 0), (3, docs[3][1], "en", "s3", 0)]
    return docs + [(300, None, None, None, None), (301, "", "en", "s1", 0), docs[8], docs[8]]


def sanitized(docs):
    texts = [d[1] for d in docs]
    pairs = test_pii.revealing(texts, 3, 0.9)
    out = []
    for d in docs:
        text = d[1]
        base = test_pii.plain(text)
        spans = list(base)
        for s, k, e, m in base:
            for x in re.finditer(r"[^\W\d_]{4,}", text):
                near = (s - 100 < x.start() or (s <= 100)) and x.end() <= s or x.start() >= e and (x.end() < e + 100 or x.end() <= len(text) < e + 100)
                if near and (f"{test_pii.pii.KINDS[k]}:{m.lower()}", x[0].lower()) in pairs:
                    spans.append((x.start(), 4, x.end(), x[0]))
        pieces, at = [], 0
        for s, k, e, _ in sorted(set(spans)):
            if s >= at:
                pieces += [text[at:s], "" if k == 4 else f"[{test_pii.pii.KINDS[k].upper()}]"]
                at = e
        out.append((d[0], "".join(pieces) + text[at:], d[2], d[3], len("".join(pieces) + text[at:]) if spans else d[4]))
    return out


def test_stages(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "personal data", "mixing", "BPE"]
    frame, rows = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        frame = spark.read.parquet(f"{tmp_path}/{i}")
        rows.append(sorted((tuple(r) for r in frame.collect()), key=str))
        assert i == 4 or frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    want = [d for d in docs if test_quality.plain(d[1])[-1]]
    assert rows[0] == sorted(want, key=str) and 0 < len(want) < len(docs)

    groups = test_simhash.plain_groups([test_simhash.plain_print(d[1]) for d in want])
    least = {g: min(d[0] for d, h in zip(want, groups) if h == g) for g in set(groups)}
    assert sorted(r[0] for r in rows[1]) == sorted(least.values())
    assert set(rows[1]) <= set(want)

    assert rows[2] == sorted(sanitized(rows[1]), key=str)
    assert any("[EMAIL]" in r[1] for r in rows[2]) and not any("@" in r[1] or "Kowalskaja" in r[1] for r in rows[2])

    sizes = {}
    for r in rows[2]:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    targets = test_mixing.targets(sizes)
    for source, target in targets.items():
        taken = sum(len(WORD.findall(r[1])) for r in rows[3] if r[3] == source)
        assert taken == round(target)
    whole = {r[0]: r for r in rows[2]}
    for r in rows[3]:
        assert r == whole[r[0]] or r[1] == " ".join(WORD.findall(whole[r[0]][1])[: len(WORD.findall(r[1]))]) and r[4] == len(r[1])

    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    library.no_truncation()
    last = []
    for r in rows[3]:
        ids = library.encode(r[1], add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        last.append((r[0], len(ids), *digest))
    assert rows[4] == sorted(last, key=str)


def test_run_and_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
