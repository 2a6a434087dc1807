"""Measures and verdicts against plain Python."""

import re
from collections import Counter

from wordloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, words string, _q int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    numbers = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    base = n < 50 or 100 * len(covered) > 50 * n
    bad = base or 10 * numbers[2] > n or numbers[1] < 2 * n or numbers[1] > 15 * n or 100 * numbers[3] > 40 * len(lines)
    return (*numbers, base, not bad)


VARIED = " ".join(f"word{i}" for i in range(80))
TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "one", "one two", "a b c", "a b c a b c", "a a a a a a", VARIED, VARIED + " word1 word2 word3",
    "é" * 50 + " ü x " + VARIED, (VARIED + "\n") * 3, "\n".join(["same line here"] * 5 + [VARIED]), "\n\n".join(f"l{i} a b" for i in range(60)),
    VARIED + " # * $ % & | < > " * 3, " ".join("x" for _ in range(100)), " ".join(f"{i}" for i in range(70)), "long " * 60000,
    " ".join(f"w{i % 2000}" for i in range(50000)), " ".join("y" * 40 + str(i) for i in range(60)), "\n" + VARIED + "\n\n" + VARIED[:50],
]


def test_measures_and_verdicts(spark):
    docs = [(i, t, "en", "clash", 1) for i, t in enumerate(TEXTS)] + [(3, "one", None, None, None)] * 2 + [(None, VARIED, None, None, None)]
    df = spark.createDataFrame(docs, SCHEMA)
    rows = quality.assess(df).collect()
    assert len(rows) == len(docs)
    want = Counter((d[0], *plain(d[1])) for d in docs)
    assert Counter(tuple(r) for r in rows) == want
    kept = quality.good_documents(df)
    assert kept.columns == df.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter(d for d in docs if plain(d[1])[-1])


def test_order_follows_rejection_per_cost():
    costs = {"few_words": (1.0, 0.1), "repeated_words": (1.0, 0.5), "symbols": (0.1, 0.2), "word_length": (1.0, 0.0), "repeated_lines": (9.0, 0.5)}
    names = [r.name for r in quality.cascade_order(costs)]
    assert names == ["symbols", "repeated_words", "few_words", "repeated_lines", "word_length"]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.assess(empty).collect() == [] and quality.good_documents(empty).collect() == []
