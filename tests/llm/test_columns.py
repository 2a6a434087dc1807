"""Stages that return their documents take further columns of any name and any clash."""

import pytest

from wordloom.llm import mixing, pii, quality, simhash

NAMES = ["_new", "_names", "_words", "_cut", "_q_text", "_id", "_row", "_h", "_b", "_spans", "_t", "_p_text", "_equal", "_own", "_last", "_epochs"]
NAMES += ["term", "component", "fingerprint", "number", "part", "order", "content", "size", "aside0", "with.dot", "two words"]
STAGES = [quality.good_documents, simhash.without_near_duplicates, pii.sanitized, mixing.mixed_documents]


@pytest.mark.parametrize("stage", STAGES, ids=lambda s: s.__name__)
def test_any_column_name(spark, stage):
    docs = [(i, f"{''.join(chr(97 + (i * 7 + j) % 26) for j in range(12))} {i} a{i}@b.org " + " ".join(f"w{i * 31 + j}" for j in range(80)), "en", "s", 1) for i in range(6)]
    plain = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    columns = ["`" + n + "` string" for n in NAMES]
    more = spark.createDataFrame(
        [d[:1] + tuple(f"{n}-{d[0]}" for n in NAMES) + d[1:] for d in docs],
        f"doc_id long, {', '.join(columns)}, text string, lang string, source string, n_chars long",
    )
    want = sorted(map(tuple, stage(plain).select("doc_id", "text", "lang", "source", "n_chars").collect()))
    out = stage(more)
    assert out.columns == more.columns
    got = out.collect()
    assert sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in got) == want and want
    assert all(r[n] == f"{n}-{r['doc_id']}" for r in got for n in NAMES)
