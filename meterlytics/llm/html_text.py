"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one classifies every block
alone: blocks of no content (scripts, styles, forms, comments of the markup)
are never read; blocks inside page furniture (``nav``, ``header``, ``footer``,
``aside``, forms, and elements whose class, id or role names such a part) are
bad; of the others, link density, length and stop-word density decide: many
links is bad (outside the content element: a title or a reference in it may be
a link), long and rich in stop words is good, long and poor is bad, the rest is
short or near-good. Pass two lets ambiguous blocks inherit from the nearest
decided neighbours; inside the page's content element (``article``, ``main``)
an ambiguous block has the element itself as its good neighbour.

Defined results: null or empty html gives empty text; markup is read as it
stands (unclosed tags are closed by their parents or at the end); repeated
rows are read each; other columns are not carried.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
                   r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAMES = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")

#: read as one unit and never shown
RAW = {"script", "style", "template", "textarea", "noscript", "svg", "math", "iframe", "object", "select", "title",
       "canvas", "audio", "video", "xmp", "noembed", "noframes"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog",
         "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
         "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup",
         "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr",
         "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "head", "menu", "button", "dialog", "fieldset", "label",
             "search"}
CONTENT = {"article", "main"}
#: words of class, id and role names that mark page furniture
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adsbygoogle", "banner",
         "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "contentinfo", "cookie",
         "cookies", "copyright", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar",
         "navigation", "navi", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup",
         "privacy", "promo", "promoted", "promotion", "related", "replies", "respond", "search", "share", "sharing",
         "sidebar", "sidebars", "signup", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe",
         "toolbar", "topbar", "widget", "widgets", "complementary", "alert", "disclaimer", "login", "feedback"}
#: stop words of four languages (fixed values)
STOP = set("""the of and to in a is that it for on with as are was be by this an or from at not have has but they you
he she his her its we their there been which one all can will more if when who so no out up into them then than
de la que el en y los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta
le les des du et est une dans pour qui sur par au pas ne ce il sont avec plus ou se son sa aux mais nous vous
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis""".split())

LONG, SHORT = 140, 60               # characters
STOP_HIGH, STOP_LOW = 0.18, 0.08    # share of stop words among the words
LINKS_HIGH = 0.33                   # share of characters inside links


class _Block:
    __slots__ = ("parts", "linked", "bad", "content", "heading")

    def __init__(self, bad: bool, content: bool, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.bad, self.content, self.heading = bad, content, heading


def _marked(name: str, attrs: str) -> bool:
    """Does the element name or an attribute mark page furniture?"""
    if name in FURNITURE:
        return True
    if not attrs or name in ("html", "body", *CONTENT):
        return False
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            if not MARKS.isdisjoint(NAMES.findall(value)):
                return True
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return True
        elif key == "itemprop" and value == "comment":
            return True
    return False


def blocks_of(page: str) -> list[_Block]:
    """Text blocks in page order with their links and surroundings."""
    out: list[_Block] = []
    stack: list[tuple[str, bool, bool]] = []      # name, in furniture, in content
    block: _Block | None = None
    links = 0
    skip = ""                                      # a raw element being passed over
    at = 0

    def text(raw: str):
        nonlocal block
        if not raw:
            return
        if block is None:
            if raw.isspace():
                return
            _, bad, content = stack[-1] if stack else ("", False, False)
            heading = any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-3:])
            block = _Block(bad, content, heading)
            out.append(block)
        raw = html.unescape(raw)
        block.parts.append(raw)
        if links:
            block.linked += len(raw)

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name:
            if m.group(1):
                text(m.group(1))
            continue
        closing, attrs = bool(m.group(2)), m.group(4) or ""
        if closing:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK:
                block = None
                links = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name == "a":
            links += 1
        if name in BLOCK:
            block = None
            if name == "p" or name in BLOCK and stack and stack[-1][0] == "p":
                # a paragraph ends where the next block begins
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK:
                        break
        if name == "li":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("ul", "ol", "menu"):
                    break
                if stack[k][0] == "li":
                    del stack[k:]
                    break
        if name in VOID or attrs.rstrip().endswith("/"):
            if name == "br" and block is not None:
                block.parts.append(" ")
            continue
        _, bad, content = stack[-1] if stack else ("", False, False)
        inner = content or name in CONTENT
        # the header of an article holds its title, not the page's menu
        mark = _marked(name, attrs) and not (content and name == "header" and not attrs)
        stack.append((name, bad or mark, inner))
    return out


GOOD, BAD, SHORTISH, NEAR = 1, 0, 2, 3


def classify(text: str, b: _Block) -> int:
    """Pass one."""
    if b.bad:
        return BAD
    n = len(text)
    if b.linked > LINKS_HIGH * n and not b.content:
        return BAD
    words = WORD.findall(text.lower())
    share = sum(w in STOP for w in words) / len(words) if words else 0.0
    if n < SHORT:
        return SHORTISH
    if share >= STOP_HIGH and n >= LONG:
        return GOOD
    if share >= STOP_LOW:
        return NEAR
    return NEAR if b.content or n < LONG else BAD


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    blocks, texts = [], []
    for b in blocks_of(page):
        t = SPACE.sub(" ", "".join(b.parts)).strip()
        if t:
            blocks.append(b)
            texts.append(t)
    label = [classify(t, b) for t, b in zip(texts, blocks)]
    n = len(label)
    # pass two: nearest decided neighbour on either side
    left, right = [BAD] * n, [BAD] * n
    last = BAD
    for i in range(n):
        left[i] = last
        if label[i] in (GOOD, BAD):
            last = label[i]
    last = BAD
    for i in range(n - 1, -1, -1):
        right[i] = last
        if label[i] in (GOOD, BAD):
            last = label[i]
    keep = []
    for i in range(n):
        if label[i] in (GOOD, BAD):
            good = label[i] == GOOD
        elif blocks[i].content:
            good = True
        elif blocks[i].heading:
            good = right[i] == GOOD
        elif label[i] == NEAR:
            good = GOOD in (left[i], right[i])
        else:
            good = left[i] == GOOD and right[i] == GOOD
        if good:
            keep.append(texts[i])
    return "\n".join(keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``."""
    prepare(pages.sparkSession)
    src = pages.select("page_id", "url", "html")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"{schema}text string, n_chars long")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
