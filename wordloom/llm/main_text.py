"""Main text of web pages by tag-path ratios: text and punctuation per root-to-leaf tag path, smoothed, fused, thresholded."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Neighbours on each side of a block whose values are mixed in, by a Gaussian of this spread.
SPREAD = 1.0
# Paths whose fused value reaches this share of the page's mean, taken over characters, hold content.
LEAST_SHARE = 0.5

# The elements of HTML by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td
    tfoot th thead tr ul""".split()
)
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
OUTSIDE = set(
    "aside audio button canvas dialog fieldset footer form head menu nav noscript object select svg template video".split()
) | RAW
OUTSIDE_ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus replies reply respond".split())
OUTSIDE_WORDS = COMMENT_WORDS | set(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header
    login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related search share
    sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split()
)
PLAIN = (BLOCK | set("a b em i span strong".split())) - OUTSIDE - {"article", "main", "header"}
# Start tags that end an open element of the same family.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = set("ul ol dl table tbody thead tfoot div section article main body html".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*+(?:>|\Z) | <(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S | re.X
)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PUNCTUATION = ".,;:!?…、。，！？"


@dataclass(slots=True)
class Element:
    """An open element: its block path, what holds its text, and whether that text is outside the article."""

    tag: str
    path: int
    article: int = -1
    outside: bool = False
    headings_only: bool = False
    link: bool = False


@dataclass(slots=True)
class Block:
    """A run of text between two block boundaries."""

    text: str
    path: int
    tag: str
    article: int
    link_chars: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    paths: dict[tuple[int, str, str], int] = field(default_factory=dict)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def _opened(tag: str, source: str, above: Element, page: Page, articles: list[int]) -> Element:
    """The element that a start tag opens inside ``above``."""
    given = _attributes(source) if "=" in source or "hidden" in source else {}
    named = {w.lower() for key in ("class", "id") if key in given for w in WORDS.findall(given[key])}
    here = Element(tag, above.path, above.article, above.outside, above.headings_only, above.link or tag == "a")
    if tag in BLOCK:
        names = " ".join(sorted(WORDS.findall(given["class"]))) if "class" in given else ""
        here.path = page.paths.setdefault((above.path, tag, names), len(page.paths) + 1)
    if tag in PLAIN and not given:
        return here
    role, hidden = given.get("role", "").lower(), "hidden" in given or given.get("aria-hidden") == "true"
    hidden = hidden or re.search(r"display\s*:\s*none", given.get("style", "")) is not None
    if tag in OUTSIDE or role in OUTSIDE_ROLES or hidden:
        here.outside = True
    elif tag in ("article", "main") or role in ("article", "main"):
        # A container with a name of the surroundings may wrap the article; a reader's comment is none.
        if not named & COMMENT_WORDS and above.article < 0:
            articles.append(len(articles))
            here.article, here.outside = articles[-1], False
        elif named & COMMENT_WORDS:
            here.outside = True
    elif tag == "header":
        here.headings_only = here.article >= 0
        here.outside = here.outside or here.article < 0
    elif tag not in ("html", "body") and named & OUTSIDE_WORDS:
        here.outside = True
    return here


def blocks_of(source: str) -> Page:
    """The text of a page in blocks, in one pass over its marks; scripts, styles, comments and surroundings are left out.

    Missing end tags are made good the usual way: a block ends an open paragraph, an item ends the item before it, an
    end tag ends all that is open inside its element, and one without a start is ignored.
    """
    page, stack, articles = Page(), [Element("", 0)], []
    count: dict[str, int] = {}
    buffer: list[str] = []
    links, at = 0, 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                top = next(e for e in reversed(stack) if e.tag in BLOCK or not e.tag)
                page.blocks.append(Block(text, top.path, top.tag, top.article, min(links, len(text))))
            buffer.clear()
        links = 0

    def pop() -> None:
        count[stack.pop().tag] -= 1

    def close(tags: set[str]) -> None:
        """End the outermost open element of these tags inside the nearest container, with all that is open in it."""
        depth = len(stack)
        for place in range(len(stack) - 1, -1, -1):
            if stack[place].tag in tags:
                depth = place
            elif stack[place].tag in HOLDS:
                break
        while len(stack) > depth:
            pop()

    def add(text: str) -> None:
        nonlocal links
        top = stack[-1]
        if top.outside or (top.headings_only and not any(count.get(h) for h in HEADING)):
            return
        text = html.unescape(text) if "&" in text else text
        buffer.append(text)
        if top.link:
            links += len(text.strip())

    size = len(source)
    while at < size:
        found = TOKEN.search(source, at)
        if found is None:
            break
        if found.start() > at:
            add(source[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if not count.get(tag):
                continue
            if tag not in BLOCK:
                # An inline end tag closes nothing beyond its block.
                inside = 0
                while stack[-1 - inside].tag != tag and stack[-1 - inside].tag not in BLOCK and stack[-1 - inside].tag:
                    inside += 1
                if stack[-1 - inside].tag == tag:
                    for _ in range(inside + 1):
                        pop()
                continue
            flush()
            while stack[-1].tag != tag:
                pop()
            pop()
            continue
        if tag in RAW:
            end = RAW_END[tag].search(source, at)
            at = end.end() if end else size
            continue
        if tag in BLOCK:
            flush()
            if count.get("p"):
                close({"p"})
            if tag in CLOSES:
                close(CLOSES[tag])
        if tag == "br":
            buffer.append(" ")
        if tag in VOID:
            continue
        stack.append(_opened(tag, found[3], stack[-1], page, articles))
        count[tag] = count.get(tag, 0) + 1
    if at < size and not re.match(r"</?[a-zA-Z]", source[at:]):
        add(source[at:])
    flush()
    return page


def path_values(blocks: list[Block]) -> np.ndarray:
    """The fused value of each block's path.

    Per path, the characters outside links and the punctuation marks are divided by the path's blocks. Both ratios,
    taken along the page, are smoothed by a Gaussian, and their product is averaged over the path again, so that all
    blocks of a path share one value.
    """
    _, path = np.unique([b.path for b in blocks], return_inverse=True)
    held = np.bincount(path)
    plain = np.array([len(b.text) - b.link_chars for b in blocks], dtype=float)
    marks = np.array([sum(map(b.text.count, PUNCTUATION)) if b.link_chars < len(b.text) else 0 for b in blocks], dtype=float)
    reach = np.arange(-2, 3)
    kernel = np.exp(-0.5 * (reach / SPREAD) ** 2)
    whole = np.convolve(np.ones(len(blocks)), kernel, "full")[2:-2]
    smooth = []
    for amount in (plain, marks):
        ratio = (np.bincount(path, amount) / held)[path]
        smooth.append(np.convolve(ratio, kernel, "full")[2:-2] / whole)
    # Text without a single mark still counts by its length.
    return (np.bincount(path, smooth[0] * (1.0 + smooth[1])) / held)[path]


def content(page: Page) -> list[Block]:
    """The blocks of the article.

    Where elements are marked as article or main part, only their blocks are looked at. A path needs a share of
    the mean value, over all characters; an article with a selected block is taken whole but for paths that are links
    throughout (menus). Without such marks the article runs from the first to the last selected block, with the
    headings right before it.
    """
    blocks = page.blocks
    if any(b.article >= 0 for b in blocks):
        blocks = [b for b in blocks if b.article >= 0]
    if not blocks:
        return []
    values = path_values(blocks)
    chosen = values >= LEAST_SHARE * np.average(values, weights=[len(b.text) for b in blocks])
    linked: dict[int, list[int]] = {}
    for b in blocks:
        seen = linked.setdefault(b.path, [0, 0])
        seen[0] += len(b.text) - b.link_chars
        seen[1] += 1
    menu = {p for p, (plain, held) in linked.items() if plain <= 0 and held > 1}
    if blocks[0].article >= 0:
        articles = {b.article for b, c in zip(blocks, chosen) if c}
        return [b for b in blocks if b.article in articles and b.path not in menu]
    places = np.flatnonzero(chosen)
    first, last = int(places[0]), int(places[-1])
    while first and blocks[first - 1].tag in HEADING:
        first -= 1
    return [b for b in blocks[first : last + 1] if b.path not in menu]


def main_text_of(source: str | None) -> str:
    """Blocks of the article in page order, one a line."""
    return "\n".join(b.text for b in content(blocks_of(source or "")))


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``.

    One pass over the rows, no shuffle; a page is read from end to end once, whatever its length, and its paths are
    numbered, so deep nesting costs no more than its marks. ``<br>`` counts as white space inside its block. Character
    references are decoded, all white space of Unicode becomes one blank. Headings of an article belong to it, also
    inside its own ``<header>``.

    An absent or empty page, or one without an article, has an empty text; repeated rows and absent ids or addresses
    stay as they are; an empty table gives no rows. Columns beside the three named ones are not read.
    """

    @F.pandas_udf("string")
    def texts(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text_of(s) for s in sources], dtype=object)

    read = pages.select("page_id", "url", texts(F.col("html").cast("string")).alias("text"))
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
