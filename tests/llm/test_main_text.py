"""Main text against a plain reading of the generated pages, and pages with every kind of surroundings."""

import html
import os
import re

import pytest

from wordloom.llm.main_text import blocks_of, extract, main_text_of

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, text string, n_chars string, _text int"
LONG = "The river, as ever, ran past the mill; nobody minded. It was late, and the lamps were lit."

PAGES = {
    "surroundings": (
        f"""<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>if (a < b) t="</p><p>no";</script></head>
        <body class="has-sidebar"><header><h1>Site name, no</h1></header><nav><ul><li><a href=/>no</a></li></ul></nav>
        <div class="cookie-notice"><p>We use cookies, all of us, all the time, and so do you. Accept, please, now.</p></div>
        <main><article><h1>Title &amp; more</h1><p>{LONG}</p><p>Short <b>and</b> <a href="/x">linked</a>.</p>
        <div class="ad">Buy, buy, buy.</div><ul><li>first item<li>second item</ul>
        <form><label>Your name, no</label><input></form></article>
        <section id="comments"><article class="comment"><p>{LONG} I disagree, strongly, with all of it.</p></article></section></main>
        <aside><p>{LONG}</p></aside><footer>&copy; no one, ever.</footer></body></html>""",
        f"Title & more\n{LONG}\nShort and linked.\nfirst item\nsecond item",
    ),
    "no marks": (
        f"""<body><div class="menu"><a href=a>a</a><a href=b>b</a></div><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>
        <div id="story"><h2>Head</h2><p>{LONG}<p>{LONG}<br>next line</p><p>Yes.</p><p>{LONG}</p></div>
        <div><span>Copyright nobody</span></div></body>""",
        f"Head\n{LONG}\n{LONG} next line\nYes.\n{LONG}",
    ),
    "one word": ("<html><body><nav>a menu, with marks. And more.</nav><div class=ad>Long advert, long.</div><article><p>Word</article>", "Word"),
    "header inside": (f"<article><header><h1>T</h1><p>by someone, today</p></header><p>{LONG}</p></article>", f"T\n{LONG}"),
    "unclosed": ("<article><p><b>one<br><p>two<p><i>three</b> four", "one\ntwo\nthree four"),
    "attributes": ('<article data-x="a > b" title=\'<p>\'><p class=lead>kept &lt;b&gt; &#233;&nbsp;&nbsp;x &amp</article>', "kept <b> é x &"),
    "white space": ("<article><p>\n a\t  b \r\n c</p>\n\n<p> </p></article>", "a b c"),
    "wrapped": (f'<div class="header-wrap"><article><p>{LONG}</p></article></div>', LONG),
    "hidden": (f'<article><p>{LONG}</p><p hidden>no</p><div style="display: none">no</div><div role="search">no</div></article>', LONG),
    "comment": (f"<article><!-- no <p>no</p> --><p>{LONG}</p><!-- never closed <p>no</p>", LONG),
    "script unclosed": ("<article><p>yes</p><script>no </p>", "yes"),
    "less than": ("<article><p>1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    "nothing": ("<html><body><nav>menu</nav><script>x</script></body></html>", ""),
    "plain": ("only words", "only words"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    source, want = PAGES[name]
    assert main_text_of(source) == want


def plainly(page):
    """The generated pages keep their article in one element whose blocks are headings and paragraphs."""
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", page, flags=re.S)[1])
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(p for p in parts if p)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_generated_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == plainly(r["html"]) and got[r["page_id"]]["url"] == r["url"]
        assert got[r["page_id"]]["n_chars"] == len(plainly(r["html"]))


def test_edge_rows(spark):
    long_page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x", "y", 0), (2, None, "", "x", "y", 0), (None, "u", "<p>a 𝄞 b", None, None, None), (3, "v", long_page, "", "", 1)]
    rows += [(4, "w", "<article><p>same", "", "", 1)] * 3
    got = sorted(map(tuple, extract(spark.createDataFrame(rows, SCHEMA)).collect()), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    whole = "\n".join([LONG] * 20_000)
    want = [(None, "u", "a 𝄞 b", 5), (1, "u", "", 0), (2, None, "", 0), (3, "v", whole, len(whole))] + [(4, "w", "same", 4)] * 3
    assert got == want
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_deep_and_odd_marks_take_one_pass():
    deep = "<div>" * 30_000 + "<p>in the deep, yes." + "</div>" * 30_000
    assert main_text_of(deep) == "in the deep, yes."
    odd = "<article>" + "<p><b>x</i></span>" * 30_000
    assert main_text_of(odd) == "\n".join(["x"] * 30_000)
    assert len(blocks_of("<a b='" * 2_000 + "x").blocks) <= 1
