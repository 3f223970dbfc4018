"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

A page runs through the standard library's streaming parser. Its events make lines (one per block element) with their text,
the number of tags and of linked characters, and the element that holds them. The ratios of text to tags are smoothed with a
Gaussian over neighbouring lines and split by a two-means threshold into content and the rest; the lines above it select the
region, which is the smallest containing element that holds nearly all of their text. Elements that by tag, role, class or id
are menus, page headers, footers, sidebars, notices, adverts, forms, scripts or reader comments are no lines of a region. Of
the region every line stays, short or long.

Defined cases: a null or empty page, and one without content, give an empty text; character references are decoded, white
space inside a block is one space, blocks are joined by one line feed; ``<br>`` is white space; unclosed and stray tags are
taken as a browser would in the main; a page is one value and is never cut; repeated rows are each extracted; an empty table
gives an empty table; other columns are carried along, and those that clash with a result column are replaced."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot
    thead tr ul""".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
# elements a region can be
CONTAINERS = frozenset("article body center div main section table tbody td html".split())
# never part of the text
DROPPED = frozenset("""aside button canvas dialog footer form head iframe input label menu nav noscript object option script select
    style svg template textarea title""".split())
# start tags that leave an open head open; any other one, or text, ends it
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# words in a class or id that name what surrounds an article
NAMES = frozenset("""ad ads adbox adslot advert adverts advertisement advertising adsense breadcrumb breadcrumbs banner comment comments
    commentlist consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation
    newsletter notice notices notification overlay pager pagination popup privacy promo promotion promoted recommended related
    replies reply respond responses share sharebar sharing sidebar signup social sponsor sponsored subscribe subscription tagcloud
    toolbar topbar widget widgets""".split())
ARTICLE_NAMES = frozenset("ad ads advert advertisement comment comments promo related reply replies sponsored teaser".split())
LAYOUT = frozenset("has is js no with without".split())
CONTENT = frozenset("article content entry post story".split())
PART = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SHARE = 0.8
LINKED = 0.6
KERNEL = tuple(exp(-k * k / 2) for k in range(-2, 3))


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether one of the class names in ``value`` holds a word of ``names``; layout classes (with-sidebar) do not count."""
    for name in value.split():
        parts = [p.lower() for p in PART.findall(name)]
        if parts and parts[0] not in LAYOUT and not names.isdisjoint(parts):
            return True
    return False


def _surrounds(tag: str, attrs: list, inside: bool) -> bool:
    """Whether an element is not part of any article. ``inside``: it lies in an article or main element."""
    if tag in DROPPED:
        return True
    if tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for key, value in attrs:
        if key in ("class", "id") and value:
            if _named(value, ARTICLE_NAMES if tag == "article" else NAMES):
                return True
            if not inside and tag != "article" and _named(value, frozenset(("header",))) and not _named(value, CONTENT):
                return True
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and value and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class Lines(HTMLParser):
    """The lines of a page. ``lines``: (text, tags, linked characters, node); ``nodes``: (tag, parent node)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.nodes: list[tuple[str, int]] = [("html", -1)]
        self.open: list[tuple[str, int, bool, bool]] = [("html", 0, False, False)]  # tag, node, surrounds, inside an article
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.heads = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.open[-1][1]))
            self.parts = []
        self.tags = self.linked = 0

    def _end_head(self, tag: str = "") -> None:
        """The end tag of a head may be left out: close it at ``tag`` or, without one, at text. What stands in an element of
        the head (a template, a noscript) stays there; only a body ends that too, if it is not a template's."""
        if self.open[-1][0] == "head" or tag == "body" and all(o[0] != "template" for o in self.open):
            while self.heads:
                self._close("head")

    def handle_starttag(self, tag, attrs):
        if self.heads and tag not in HEAD:
            self._end_head(tag)
        if tag in BLOCKS:
            self.flush()
            if self.open[-1][0] == "p" or any(o[0] == "p" for o in self.open[-8:]):
                self._close("p")
            if tag in ("li", "dt", "dd", "tr"):
                self._close_own(tag)
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in ("td", "th"):
            self.parts.append(" ")
        _, node, surrounds, inside = self.open[-1]
        off = (surrounds and tag != "main") or _surrounds(tag, attrs, inside)
        if off and not surrounds:
            self.flush()
        if tag in BLOCKS or tag == "td":
            self.nodes.append((tag, node))
            node = len(self.nodes) - 1
        elif tag == "a":
            self.links += 1
        elif tag == "head":
            self.heads += 1
        self.open.append((tag, node, off, inside or tag in ("article", "main")))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        self._close(tag)

    def _close(self, tag: str) -> None:
        """Close the last open ``tag``; an inline element or a paragraph is not looked for beyond the enclosing block."""
        block = tag in BLOCKS and tag != "p" or tag == "head"
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name == tag:
                while len(self.open) > k:
                    name, _, surrounds, _ = self.open[-1]
                    if name in BLOCKS or surrounds and not self.open[-2][2]:
                        self.flush()
                    if name == "a":
                        self.links -= 1
                    elif name == "head":
                        self.heads -= 1
                    self.open.pop()
                return
            if not block and name in BLOCKS and name != "p":
                return

    def _close_own(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self._close(tag)
                return
            if self.open[k][0] in ("ul", "ol", "dl", "table", "menu"):
                return

    def handle_data(self, data):
        if self.heads and data.strip(" \t\n\r\f"):
            self._end_head()
        if not self.open[-1][2]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(values: list[float]) -> list[float]:
    n = len(values)
    out = []
    for i in range(n):
        total = weight = 0.0
        for k, w in enumerate(KERNEL, i - 2):
            if 0 <= k < n:
                total += w * values[k]
                weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The value between the means of the low and the high cluster; below all values where they are one cluster."""
    low, high = min(values), max(values)
    if high < 2 * low or high - low < 1:
        return low - 1
    for _ in range(20):
        cut = (low + high) / 2
        above = [v for v in values if v > cut]
        below = [v for v in values if v <= cut]
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    # content is what is not clearly of the low cluster
    return low + (high - low) / 4


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html.replace("<![", "<! ["))
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _, _ in lines])
    cut = threshold(ratios)
    nodes = parser.nodes
    held = [0] * len(nodes)
    total = 0
    chosen = [r > cut and linked <= LINKED * len(text) for r, (text, _, linked, _) in zip(ratios, lines, strict=True)]
    if not any(chosen):
        chosen = [True] * len(lines)
    for yes, (text, _, _, node) in zip(chosen, lines, strict=True):
        if yes:
            total += len(text)
            while node >= 0:
                held[node] += len(text)
                node = nodes[node][1]
    region = 0
    for k in range(1, len(nodes)):  # parents come before their children
        if held[k] >= SHARE * total and nodes[k][0] in CONTAINERS and nodes[k][1] == _container(nodes, nodes[k][1], region):
            region = k
    above, article = region, -1
    while above >= 0:
        if nodes[above][0] in ("article", "main"):
            article = above
            break
        above = nodes[above][1]
    region = article if article >= 0 else region
    inside = [False] * len(nodes)
    for k, (_, parent) in enumerate(nodes):
        inside[k] = k == region or parent >= 0 and inside[parent]
    out = [text for yes, (text, _, linked, node) in zip(chosen, lines, strict=True) if inside[node] and (yes or article >= 0 or linked <= LINKED * len(text))]
    return "\n".join(out)


def _container(nodes: list[tuple[str, int]], node: int, region: int) -> int:
    """``node`` if it lies in ``region`` or is it, else -2: a region is only ever narrowed."""
    at = node
    while at >= 0:
        if at == region:
            return node
        at = nodes[at][1]
    return -2


def extracted(pages: DataFrame, html_col: str = "html", keep_html: bool = False) -> DataFrame:
    """``pages`` (with the html only if ``keep_html``) with text and n_chars."""
    pages = pages.drop(*(c for c in ("text", "n_chars") if c != html_col))
    kept = [f for f in pages.schema.fields if keep_html or f.name != html_col]
    place = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(place)]
            columns = [batch.column(pages_place[f.name]) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in kept), "text", "n_chars"])

    pages_place = {name: i for i, name in enumerate(pages.columns)}
    pages = pages.withColumn(html_col, F.col(html_col).cast("string"))
    return pages.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
