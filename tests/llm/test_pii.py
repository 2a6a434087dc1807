"""Patterns against Python's, Luhn, and revealing terms against a plain count."""

import hashlib
import math
import random
import re

from wordloom.llm import pii, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, _x int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    spans = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = "".join(c for c in m[0] if c.isdigit())
            ok = {
                "email": True,
                "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[name]
            if ok:
                spans.append((m.start(), k, m.end(), m[0]))
    return sorted(spans)


CARD = "4111 1111 1111 1111"
FIXED = [
    None, "", "a@b.c@d.e", "a@b.c_d@e.f", "x@y", "é ü a.b+c@mail-1.example.com. ü 1.2.3.4", "1.2.3.4.5.6.7.8", "0.0.0.0 10.0.0.1 000.1.00.2 0.0.0.256 256.1.1.1 001.02.3.0255 99999999999999999999.1.1.1",
    CARD, "4111-1111-1111-1111 4111 1111 1111 1112", "+1 (234) 555-7890", "+12 34", "+1-2345678901234567", f"+1 234 555 7890 {CARD}", "😀 a@b.co 😀 1.1.1.1",
    "7" * 30000, "a" * 30000, "a@b" + ".c" * 20000, "1." * 20000, "a@" * 5000, "tel +49 (0)30 1234567 and +49 (0)30 1234567", "4111111111111111" + " 5" * 3,
]


def base_rows(spark, texts):
    df = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    rows = df.withColumn("_p_text", pii.whole_text()).withColumn("_b", pii.base_spans("x")).select("doc_id", "_b").collect()
    return {r["doc_id"]: [tuple(x) for x in r["_b"]] for r in rows}


def test_base_spans(spark):
    random.seed(3)
    made = ["".join(random.choices("0123456789.+-() @ab_%é\n", weights=[6] * 10 + [5] * 12 + [1], k=random.choice([20, 200]))) for _ in range(400)]
    texts = FIXED + made
    got = base_rows(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t


def entities(kind, value):
    digits = re.sub("[^0-9]", "", value)
    name = pii.KINDS[kind]
    part = {
        "email": [f"email-host:{value.split('@')[-1]}", f"email-name:{re.sub('[^a-z]', '', value.split('@')[0])}"],
        "ip": [f"ip-net:{'.'.join(value.split('.')[:2])}"],
        "card": [f"card-issuer:{digits[:6]}"],
        "phone": [f"phone-area:{digits[:4]}"],
    }[name]
    return [e for e in [f"{name}:{value}", *part, name] if not e.endswith(":")]


def revealing(texts, support, disclosed):
    """Pairs of entity and term that pass."""
    texts = {t or "" for t in texts}
    total, near, values, holders = len(texts), {}, {}, {}
    for t in texts:
        spans = plain(t)
        held = {e for _, k, _, m in spans for e in entities(k, m.lower())}
        words = {x[0].lower() for x in re.finditer(r"[^\W\d_]+", t) if not any(a < x.end() and x.start() < b for a, _, b, _ in spans)}
        for w in {w.lower() for w in re.findall(r"[^\W\d_]+", t)}:
            holders[w] = holders.get(w, 0) + 1
        for v in held:
            values.setdefault(v, set()).add(t)
            for w in words:
                near.setdefault((v, w), set()).add(t)
    out = set()
    for (v, w), both in near.items():
        pmi = math.log2(len(both) * total / (holders[w] * len(values[v])))
        content = -math.log2(len(values[v]) / total)
        least = 0 if re.match("[a-z]+:", v) else pii.INFORMATION
        if len(both) >= support and content > 0 and content >= least and pmi >= disclosed * content:
            out.add((v, w))
    return out


CORPUS = [f"Report {i}: agent Zanzibarov mails zan.z@spy.example.org about number {i} today" for i in range(4)]
CORPUS += [f"common words today about agent number {i} report mails" for i in range(60)] + ["plain"] * 3 + [None, "", CORPUS[0], CORPUS[0]]


def test_revealing_terms(spark):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in enumerate(CORPUS)], SCHEMA)
    rows = pii.find_personal(df).collect()
    want = revealing(CORPUS, pii.SUPPORT, pii.DISCLOSED)
    assert {w for _, w in want} == {"zanzibarov"}
    for r in rows:
        terms = {x["m"] for x in r["_spans"] if x["k"] == 4}
        assert terms == ({"zanzibarov"} if "Zanz" in (r["text"] or "") else set())
        assert all(r["text"][x["s"] : x["e"]].lower() == x["m"] for x in r["_spans"] if x["k"] == 4)
        assert [tuple(x) for x in r["_b"]] == plain(r["text"])
    clean = {r["doc_id"]: r for r in pii.sanitized(df).collect()}
    assert clean[1]["text"] == "Report 1: agent  mails [EMAIL] about number 1 today" and clean[1]["n_chars"] == len(clean[1]["text"])
    assert [clean[i]["text"] for i in range(4, len(CORPUS) - 2)] == CORPUS[4:-2]
    assert pii.sanitized(df).columns == df.columns


def test_overlaps_and_empty(spark):
    text = f"see +1 234 555 7890 or 10.0.0.1@x.org, {CARD}"
    df = spark.createDataFrame([(1, text, None, None, None, None, None)] * 2, SCHEMA)
    rows = pii.sanitized(df).collect()
    assert len(rows) == 2 and all(r["text"] == "see [PHONE] or [EMAIL], [CARD]" for r in rows)
    assert pii.sanitized(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in enumerate(FIXED + CORPUS)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(FIXED + CORPUS)
    for r in rows:
        spans = plain((FIXED + CORPUS)[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r["spans"].split(",")) | {""}


def test_terms_of_whole_texts(spark):
    """Short and distant terms count, and every place of a kept term is a span; words that overlap an address are none."""
    gap = " ".join(["common filler words"] * 20)
    corpus = [f"Lee 李明 wrote {gap} {i} to éwho@spy.example.org. {gap} Lee and Zanzibarov, lee\ufdd0 {i}" for i in range(4)]
    corpus += [f"{gap} wrote to and {i}" for i in range(80)] + [corpus[0]]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), "x", 1) for i, t in enumerate(corpus)], SCHEMA)
    for r in pii.find_personal(df).collect():
        names = ("lee", "李明", "zanzibarov") if "Lee" in r["text"] else ()
        want = [(m.start(), 4, m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", r["text"]) if m[0].lower() in names]
        assert [tuple(x) for x in r["_spans"]] == sorted(plain(r["text"]) + want) and len(want) in (0, 5)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitized(df).collect()}
    assert clean[2] == f"  wrote {gap} 2 to é[EMAIL]. {gap}  and , \ufdd0 2" and clean[50] == corpus[50]


def marked(texts):
    """Term spans of every text by plain counting."""
    kept, out = revealing(texts, pii.SUPPORT, pii.DISCLOSED), []
    for t in texts:
        spans = plain(t)
        names = {w for v, w in kept if v in {e for _, k, _, m in spans for e in entities(k, m.lower())}}
        words = re.finditer(r"[^\W\d_]+", t or "")
        found = [x for x in words if x[0].lower() in names and not any(a < x.end() and x.start() < b for a, _, b, _ in spans)]
        out.append([(x.start(), 4, x.end(), x[0].lower()) for x in found])
    return out


def test_parts_of_values_and_kinds(spark):
    """Different values of one host, net, area or kind protect what only their texts tell; texts without values stay."""
    corpus = [f"Quorra wrote from p{i}x@quorra.example.org, desk {i}" for i in range(4)]
    corpus += [f"node Kestrel answers at 10.77.{i}.{i + 1} again {i}" for i in range(4)] + [f"call Ulverton +49 30 55{i} 77 88 99 soon {i}" for i in range(5)]
    corpus += [f"wrote from the desk, node answers at night, call again soon {i} {'Kestrel' if i == 7 else ''}" for i in range(150)]
    want = marked(corpus)
    assert {w for row in want for _, _, _, w in row} == {"quorra", "ulverton"} | ({"kestrel"} if want[4] else set()) and want[0]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), "x", 1) for i, t in enumerate(corpus)], SCHEMA)
    for r in pii.find_personal(df).collect():
        assert [tuple(x) for x in r["_spans"]] == sorted(plain(r["text"]) + want[r["doc_id"]])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitized(df).collect()}
    assert [clean[i] for i in range(13, len(corpus))] == corpus[13:] and clean[1] == " wrote from [EMAIL], desk 1"


def test_documents_have_revealing_terms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = [r["text"] for r in docs.select("text").orderBy("doc_id").collect()]
    want = marked(texts)
    got = [[tuple(x) for x in r["_spans"] if x["k"] == 4] for r in pii.find_personal(docs).orderBy("doc_id").select("_spans").collect()]
    assert got == want and sum(map(len, want)) > 0


def test_many_values_in_one_text(spark):
    """Twenty thousand values in a text are found and replaced in time that grows with their number."""
    text = " ".join(f"é{i} a{i}@b{i}.cd 10.0.{i % 300}.7" for i in range(10_000)) + " end"
    df = spark.createDataFrame([(1, text, None, None, None, None, None)], SCHEMA)
    rows = df.withColumn("_p_text", pii.whole_text()).withColumn("_b", pii.base_spans("x")).select("_b").head()["_b"]
    want = plain(text)
    assert [tuple(x) for x in rows] == want and len(want) > 18_000
    out, at = [], 0
    for s, k, e, _ in want:
        out += [text[at:s], f"[{pii.KINDS[k].upper()}]"]
        at = e
    assert pii.sanitized(df).head()["text"] == "".join(out) + text[at:]
