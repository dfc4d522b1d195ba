"""Main text of web pages from a stream of standard-library parser events.

The parser's events are cut into lines at block tags. Each line has a ratio of text, but for that of links, to tags, zero where the
markup itself says it is no content (menus, footers, scripts, forms, adverts, comments of readers). The ratios are smoothed
with a Gaussian along the page, and two clusters of them give a threshold. The regions of a page are its containers; those
whose smoothed ratio reaches it are content. Where an article is marked, what stands outside is none, and the containers in
it that are links for the most part are content only if their ratio reaches the threshold: lists of links, rows of teasers.
What an article holds beside them, and other lines of a content region, are kept whole, short ones too.

Null, empty and tag-free texts: null and empty give an empty text; a text without tags is one region and is kept. Broken
markup (unclosed, crossed or truncated tags) never raises. Pages of any length are read as a whole. Repeated rows are judged
alike, each on its own. An empty table gives an empty table. A ``keep`` column of the name ``text`` becomes ``kept_text``.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, per_batch

# HTML elements by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul""".split())
DROPPED = set("""script style noscript template head title nav footer aside form menu button select option textarea input iframe object svg canvas math
dialog audio video map datalist""".split())
REGION = set("article main section div td body".split())
WITHIN = set("section div table ul ol dl".split())
CLOSES_P = BLOCK - {"br", "option", "optgroup", "caption", "legend"}
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Names in class, id and role that mark what is no content.
NAMES = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner menu menubar nav navbar navigation
breadcrumb breadcrumbs sidebar aside masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup
login social share sharing sharebar related recommended recommendations comment comments commentlist disqus respond reply replies widget widgets toolbar
pagination pager copyright disclaimer alert complementary contentinfo search form""".split())
PAGE_HEAD = set("header site-header page-header global-header top-header siteheader pageheader".split())
SPLIT = re.compile(r"[\s_-]+")


def boilerplate(tag: str, attrs: list, in_article: bool) -> bool:
    """Whether the markup says that an element is no content."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if tag in ("html", "body"):
        return False
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = SPLIT.split(word)
                if not {"with", "has", "no", "without"} & set(parts) and (word in PAGE_HEAD and not in_article or parts[0] in NAMES or parts[-1] in NAMES):
                    return True
    return False


class Lines(HTMLParser):
    """Lines of a page: [text, tags, dropped, region, in an article, characters of links]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]  # tag, dropped, region, in an article
        self.regions, self.tags, self.parts, self.links = 1, 0, [], 0

    def cut(self) -> None:
        if self.parts:
            _, dropped, region, article = self.open[-1]
            text = " ".join("".join(self.parts).split())
            self.lines.append([text, self.tags, dropped, region, article, min(self.links, len(text))])
            self.parts, self.tags, self.links = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.cut()
            if tag in CLOSES_P:
                self.leave("p", ("article", "main", "section", "div", "td", "li", "nav", "aside", "footer", "header", "form", "button"))
            if tag in ITEMS:
                self.leave(tag, ITEMS[tag])
        self.tags += 1
        if tag in VOID:
            return
        _, dropped, region, article = self.open[-1]
        out = boilerplate(tag, attrs, article)
        if out != dropped and not dropped:
            self.cut()
        if tag in ("article", "main") and not out:
            if not any(t in DROPPED and d for t, d, _, _ in self.open):
                dropped = False  # an advert that was never closed, or a wrapper with an unlucky name
            article = True
        if tag in (WITHIN if article and tag not in ("article", "main") else REGION):
            self.regions += 1
            region = self.regions
        if tag in ("article", "main") and not out:
            region = 0  # of all articles
        self.open.append((tag, dropped or out, region, article))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def leave(self, tag: str, within: tuple | set = ()) -> None:
        """Close the nearest open ``tag``, unless one of ``within`` is nearer."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if any(x[1] for x in self.open[k:]):
                    self.cut()
                del self.open[k:]
                return
            if self.open[k][0] in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        self.leave(tag)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if any(x[0] == "a" for x in self.open):
            self.links += len(" ".join(data.split()))


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing; the kernel is cut at three sigma and normed at the edges."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        w = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi])) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """The middle between the means of the two clusters of the values (two-means from the extremes)."""
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        a, b = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not b or (new := (sum(a) / len(a), sum(b) / len(b))) == (low, high):
            break
        low, high = new
    return (low + high) / 2


def extract(html: str | None) -> str:
    """The main text: blocks in page order, joined by line feeds."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    return "\n".join(text for text, _ in content([x for x in parser.lines if x[0]]))


def content(lines: list[list], least: float | None = None) -> list[tuple[str, int]]:
    """(text, region) of the lines that are content; ``least`` takes the place of the threshold."""
    marked = any(article and not dropped for _, _, dropped, _, article, _ in lines)
    if marked:  # what stands outside the marked article counts as no content
        lines = [[text, tags, dropped or not article, region, article, links] for text, tags, dropped, region, article, links in lines]
    own = [0.0 if dropped else (len(text) - links) / max(1, tags) for text, tags, dropped, _, _, links in lines]
    ratio = smoothed(own)
    cut = (threshold(ratio) if ratio else 0.0) if least is None else least
    best: dict[int, list[float]] = {}  # of a region: its best smoothed ratio, its best own one (neighbours alone make no content), characters of links and others
    for (text, _, dropped, region, _, links), r, x in zip(lines, ratio, own):
        if not dropped:
            was = best.setdefault(region, [0.0, 0.0, 0, 0])
            best[region] = [max(was[0], r), max(was[1], x), was[2] + links, was[3] + len(text) - links]
    kept = {region for region, (r, x, links, others) in best.items() if r >= cut and 2 * x >= cut or marked and (not region or others > links)}
    return [(text, region) for text, _, dropped, region, _, _ in lines if not dropped and region in kept]


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keep`` columns and ``text`` of each page. A map over the rows: no shuffle, no state between rows."""
    types, names = dict(pages.dtypes), free_names(keep, ["text"])
    schema = ", ".join(f"`{n}` {types[c]}" for n, c in zip(names, keep)) + ", text string"
    return per_batch(pages.select(*(F.col(c).alias(n) for n, c in zip(names, keep)), F.col(html_col)), schema, lambda b: [*b.columns[: len(keep)], [extract(x) for x in b.column(len(keep)).to_pylist()]])
