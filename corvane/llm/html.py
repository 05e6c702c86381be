"""Main text of web pages by text-to-tag ratios over lines of parser events.

The standard library's streaming parser turns a page into lines, one for each block. What lies in
elements that are never part of an article (menus, forms, scripts, notices, adverts, comments of
readers) is told by element and role and left out as the events stream by; what only a class or id tells is left out unless it holds more
content than the rest. Each line of the rest
has a ratio of text to tags, the ratios are smoothed by a Gaussian, and lines above a threshold
between the two clusters of ratios form the content; short lines between content lines go with them.
Where a page marks its article by <article> or <main> and no more content lies outside than is
marked, the marks bound the content: all marked lines are it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches

#: Elements by their part in a page.
DROP = frozenset("script style noscript template svg math canvas iframe object embed head title nav footer aside form button select option textarea input label fieldset menu dialog audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening block ends if they are open (HTML's optional end tags).
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "summary", "figcaption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl td th article section div main body blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
#: Words of classes and ids that name parts beside the article.
BESIDE = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices alert nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer foot masthead topbar toolbar header share sharing social related recommended comment comments disqus replies respond discussion subscribe newsletter signup login search pagination pager skip hidden tags byline-share outbrain taboola".split())
BESIDE |= frozenset("ad-banner ad-container ad-slot comment-list comments-area cookie-banner cookie-consent cookie-notice newsletter-signup related-articles related-posts share-buttons site-footer site-header site-nav social-links social-share".split())
#: Those whose articles are never the page's own.
OTHERS = frozenset("comment comments comment-list comments-area disqus replies respond discussion related related-articles related-posts recommended outbrain taboola".split())
#: Those that a page's own story has at times, too.
WEAK = frozenset("tags login search header share sharing social alert notice notices hidden skip widget widgets rail overlay modal popup".split())
#: Width of the Gaussian in lines.
SIGMA = 1.0
SPACE = re.compile(r"\s+")


def names_of(attrs: list[tuple[str, str | None]]) -> set[str]:
    """The whole names in an element's classes and ids."""
    return {name for k, v in attrs if v and k in ("class", "id") for name in v.lower().split()}


def beside(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element's attributes hide it or give it a role beside the article."""
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true":
            return True
        if not v:
            continue
        if k == "role" and v.strip().lower() in ROLES:
            return True
        if k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            return True
    return False


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Lines(HTMLParser):
    """Collects (text, tags, link characters, marked, heading, name) of each block as events stream in.

    name: the number of the innermost open element that only a name puts beside the article, 0 for none. `around` has the one around
    each, `others` those of readers' comments and other articles, `weak` those that have weak names alone. Places of open elements are kept by tag, so an event costs the same however deep it stands.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # element, whether it is left out, and its number if only a name says that it lies beside
        self.at: dict[str, list[int]] = {}  # places in open, by tag
        self.blocks: list[int] = []
        self.walls: list[int] = []  # places of elements that end the search for one to close
        self.out = 0  # left-out elements that are open
        self.named: list[int] = []
        self.around = [0]
        self.others: set[int] = set()
        self.weak: set[int] = set()
        self.marked = self.links = self.headings = 0  # open ones
        self.any_marked = False  # whether an article that counts was open before
        self.lines: list[tuple[str, int, int, bool, bool, int]] = []
        self.parts: list[str] = []
        self.tags = self.link_chars = 0

    def flush(self) -> None:
        if text := SPACE.sub(" ", "".join(self.parts)).strip():
            self.lines.append((text, self.tags, self.link_chars, self.marked > 0, self.headings > 0, self.named[-1] if self.named else 0))
            self.tags = 0
        self.link_chars = 0
        self.parts = []

    def push(self, tag: str, left_out: bool, name: int) -> None:
        k = len(self.open)
        self.at.setdefault(tag, []).append(k)
        if tag in BLOCK:
            self.blocks.append(k)
        if tag in SCOPE or left_out:
            self.walls.append(k)
        if name:
            self.named.append(name)
        self.open.append((tag, left_out, name))
        self.out += left_out
        self.marked += tag in ("article", "main")
        self.links += tag == "a"
        self.headings += tag in HEADINGS

    def pop(self, at: int) -> None:
        while len(self.open) > at:
            tag, left_out, name = self.open[-1]
            if tag in BLOCK and not self.out:
                self.flush()
            self.open.pop()
            k = len(self.open)
            self.at[tag].pop()
            for places in (self.blocks, self.walls):
                if places and places[-1] == k:
                    places.pop()
            if name and self.named and self.named[-1] == name:
                self.named.pop()
            self.out -= left_out
            self.marked -= tag in ("article", "main")
            self.links -= tag == "a"
            self.headings -= tag in HEADINGS

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def close_open(self, tags: frozenset | set) -> None:
        """Ends the innermost of the tags that is open within its scope."""
        at = max(map(self.last, tags))
        if at >= 0 and at >= (self.walls[-1] if self.walls else 0):
            self.pop(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br" or tag == "wbr":
            self.parts.append(" " * (tag == "br" and not self.out))
            return
        if tag in CLOSES_P:
            self.close_open({"p"})
        if tag in SIBLINGS:
            self.close_open(SIBLINGS[tag])
        if tag in BLOCK and not self.out:
            self.flush()
        if tag in VOID:
            return
        inside, left_out, name = self.marked > 0, False, 0
        if tag in ("article", "main"):
            if self.named and not self.out and not self.any_marked and self.others.isdisjoint(self.named):  # the names around it are no reason
                self.named = []
            self.any_marked |= not self.out and not self.named
        else:
            # a header within the article holds its title; elsewhere it is the site's
            left_out = tag in DROP or tag == "header" and not inside or tag not in ("body", "html") and bool(attrs) and beside(attrs)
            names = names_of(attrs) & BESIDE if attrs and not left_out and not self.out and tag not in ("body", "html") else set()
            if names - {"header"} if inside else names:
                name = len(self.around)
                self.around.append(self.named[-1] if self.named else 0)
                if tag not in BLOCK:
                    self.flush()
                if names & OTHERS:
                    self.others.add(name)
                elif names <= WEAK:
                    self.weak.add(name)
        self.push(tag, left_out, name)
        if not self.out:
            self.tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in BLOCK | DROP:
            if tag == "br":
                self.handle_starttag(tag, attrs)
            return
        self.handle_starttag(tag, attrs)  # the slash means nothing on other elements

    def handle_endtag(self, tag: str) -> None:
        at = self.last(tag)
        if at < 0:
            if tag == "p" and not self.out:
                self.flush()
            return
        if tag not in BLOCK and tag not in DROP and self.blocks and self.blocks[-1] > at:
            return  # an inline end tag doesn't end blocks
        if not self.out:
            self.tags += 1
            if self.open[at][2] and tag not in BLOCK:
                self.flush()
        self.pop(at)

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data)

    def done(self) -> list[tuple[str, int, int, bool, bool, int]]:
        self.close()
        self.pop(0)
        self.flush()
        return self.lines


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """x under a Gaussian; at the ends the weights within are scaled up."""
    r = int(3 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, w, "same")[: len(x)] / np.convolve(np.ones(len(x)), w, "same")[: len(x)] if len(x) > 2 * r else np.array([(x * np.exp(-0.5 * ((np.arange(len(x)) - i) / sigma) ** 2)).sum() / np.exp(-0.5 * ((np.arange(len(x)) - i) / sigma) ** 2).sum() for i in range(len(x))])


def two_clusters(x: np.ndarray) -> float:
    """The threshold halfway between the means of two clusters of values."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        at = (low + high) / 2
        a, b = x[x <= at], x[x > at]
        if not len(a) or not len(b):
            break
        new = float(a.mean()), float(b.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def chosen(lines: list[tuple]) -> list[bool]:
    """Which of the lines are content by their ratios, and by the marks where there are any."""
    if not lines:
        return []
    size = np.array([len(x[0]) for x in lines], float)
    link = np.array([min(x[2], len(x[0])) for x in lines], float)
    tags = np.array([x[1] for x in lines], float)
    ratio = np.log1p((size - link) / (1 + tags))
    even = smooth(ratio)
    keep = even > two_clusters(even) if even.max() > even.min() + 0.5 else np.ones(len(lines), bool)
    plain = link <= 0.5 * size  # else a list of links
    keep &= plain
    at = np.flatnonzero(keep)
    if len(at):  # short lines between content lines, and headings above them, go with them
        gap = np.append(np.diff(at), 0)
        for i, g in zip(at.tolist(), gap.tolist(), strict=True):
            if 1 < g <= 4:
                keep[i + 1 : i + g] = plain[i + 1 : i + g]
            while i and lines[i - 1][4] and plain[i - 1] and not keep[i - 1]:
                i -= 1
                keep[i] = True
    marked = np.array([x[3] for x in lines])
    if marked.any() and size[marked].sum() >= size[keep & ~marked].sum():
        keep = marked
    return keep.tolist()


def content(lines: list[tuple], around: list[int], others: set[int], weak: set[int]) -> list[str]:
    """The lines that are content. What a name puts beside the article is left out, unless a weak name holds more content by its ratios than
    all that stays, or nothing stays at all.

    Such a name is passed over, one at a time, the one that holds most first; those of readers' comments and of other articles never
    are. Each time what stays more than doubles, so few are.
    """
    over: set[int] = set()
    while True:
        # of each name: how many of it and those around it stand, the outermost of them, and whether one is of others
        n, first, other = [0], [0], [False]
        for k in range(1, len(around)):
            up, stands = around[k], k not in over
            n.append(n[up] + stands)
            first.append(first[up] or (k if stands else 0))
            other.append(other[up] or k in others)
        stays = [x for x in lines if not n[x[5]]]
        kept = [x[0] for x, k in zip(stays, chosen(stays), strict=True) if k]
        size, held = sum(map(len, kept)), {}
        for x in lines:
            k = x[5]
            if n[k] == 1 and not other[k] and (first[k] in weak or not size):
                held.setdefault(first[k], []).append(x)
        sizes = {k: sum(len(x[0]) for x, c in zip(xs, chosen(xs), strict=True) if c) for k, xs in held.items()}
        top = max(sizes, key=sizes.get, default=0)
        if not top or sizes[top] <= size:
            return kept
        over.add(top)


def main_text(html: str | None) -> str:
    """The article's blocks, joined by empty lines; empty for null, empty or textless pages."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html.replace("\0", "�"))
    return "\n\n".join(content(parser.done(), parser.around, parser.others, parser.weak))


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages without `html`, with `text` and `n_chars` (code points); columns of these names are replaced, others pass through.

    Null, empty and textless pages have an empty text and n_chars 0; pages of any length and depth are read whole, as events;
    repeated rows get equal results, an empty table an empty one.
    """
    keep = [c for c in pages.columns if c not in (html, text, n_chars)]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), f"`{text}` string, `{n_chars}` long"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            texts = [main_text(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, text, n_chars])

    return pages.select(*[f"`{c}`" for c in keep], f"`{html}`").mapInArrow(run, schema)
