"""Main-text extraction from HTML.

A page is read as a stream of standard-library parser events that are folded
into lines (blocks of text). Each line has a text-to-tag ratio over its text
outside links; the ratios are smoothed with a Gaussian along the page, two
clusters of them give a threshold, and the content regions (containers of
lines) that reach it are kept.

Elements that never hold article text (scripts, styles, menus, forms) give no
lines. Everything else that tells of headers, footers, sidebars, notices,
adverts or reader comments (element, role, whole class or id tokens) and being
outside of an article that holds most of the page is a feature: such lines
have ratio 0 and are left to the threshold. Lists and tables, and all regions
within an article, go with the region around them, unless most of their text is
linked and they miss the threshold themselves.

Defined results: null or empty html gives an empty text; markup without any
text gives an empty text; broken markup is read as far as the parser's error
recovery goes; references to numbers beyond Unicode give U+FFFD; repeated pages
give repeated rows; an input column named as an output column is replaced.
Memory is proportional to the page, however deep its elements nest, and so is
time: the parser looks for the end of every tag and comment anew, so where more
than ``OPEN`` of them begin and none ends, all from the first of them on is the
inside of one unclosed tag or comment and is left out, as browsers do.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never hold article text.
DROPPED = frozenset(
    "nav form script style noscript template iframe svg button select textarea head title menu dialog object canvas audio video datalist map math noembed noframes".split()
)
#: Elements that stand around an article.
EDGE_TAGS = frozenset("header footer aside".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
#: Containers that are regions by themselves, and those that go with the region around them.
REGIONS = frozenset("article main section div body".split())
PARTS = frozenset("ul ol dl table".split())
#: Elements that an article may stand in although nothing else does.
POROUS = frozenset("nav header footer form head".split())
#: Tags or comments that may begin behind the page's last end of one, before they are cut off.
OPEN = 64
_BEGINS = re.compile(r"<[A-Za-z/!?]")
CELLS = frozenset(("td", "th", "br", "img", "option"))
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
#: Words of class and id tokens that tell of something else than article text.
CHROME = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion sidebar sidebars menu menus nav navs navbar navigation breadcrumb breadcrumbs masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login social share sharing sharebar related recommended recommendations comment comments commentlist disqus respond reply replies toolbar widget widgets pagination pager skip header footer banner".split()
)
#: Words that such a token may have beside them; with any other word it tells nothing.
GLUE = frozenset(
    "site page top bottom box bar list area block container wrapper wrap inner outer row slot unit panel pane section item items link links button buttons form posts articles stories news message text content user reader to the us me".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LONG_NUMBER = re.compile(r"&#0*([0-9]{8,}|(?<=0)[0-9]{0,7}(?![0-9]))")


def is_chrome_token(token: str) -> bool:
    """Whether all of a class or id token's words speak of page furniture, numbers aside."""
    words = [w.lower() for w in _WORDS.findall(token) if not w.isdigit()]
    return any(w in CHROME for w in words) and all(w in CHROME or w in GLUE for w in words)


def is_chrome(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element or its attributes mark it as something else than article text."""
    if tag in EDGE_TAGS:
        return True
    for name, value in attrs:
        if name == "hidden":
            return True
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and _HIDDEN.search(value):
            return True
        if (name == "class" and tag not in ("html", "body", "main") or name == "id" and tag in BLOCKS and tag not in HEADINGS and tag not in ("html", "body", "main")) and any(map(is_chrome_token, value.split())):
            return True
    return False


@dataclass(slots=True)
class Line:
    """A block of text: tags since the last one, region, articles around it, and characters in links."""

    text: str
    tags: int
    region: int
    articles: int
    main: bool
    links: int
    marked: bool

    @property
    def own(self) -> int:
        return len(self.text) - min(self.links, len(self.text))


@dataclass(slots=True)
class Element:
    tag: str
    dropped: bool = False
    marked: bool = False
    region: int = 0
    articles: int = 0
    main: bool = False


class LineReader(HTMLParser):
    """Folds parser events into lines; ``parent`` has the region around each region that goes with it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Element("")]
        self.open: Counter[str] = Counter()
        self.open_blocks = 0
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.parent: dict[int, int] = {}
        self.tags = self.regions = self.links = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                at = self.stack[-1]
                self.lines.append(Line(text, self.tags, at.region, at.articles, at.main, self.links, at.marked))
                self.tags = self.links = 0
            self.parts = []

    def pop(self) -> None:
        gone = self.stack.pop()
        self.open[gone.tag] -= 1

    def pop_to(self, tag: str) -> None:
        """Close elements up to the innermost open ``tag``, if there is one."""
        if self.open[tag] > 0:
            while self.stack[-1].tag != tag:
                if self.stack[-1].tag in BLOCKS:
                    self.flush()
                self.pop()
            self.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            if tag in ("body", "article", "main"):
                while len(self.stack) > 1 and self.stack[-1].tag in POROUS:
                    self.pop()
            elif tag in ("li", "dt", "dd", "tr") and self.stack[-1].tag in (tag, "p", "dt", "dd"):
                self.pop()
            if self.open["p"] and any(x.tag == "p" for x in self.stack[-6:]):
                self.pop_to("p")
        elif tag in CELLS:
            self.parts.append(" ")
        if tag in VOID:
            return
        above = self.stack[-1]
        at = Element(tag, above.dropped or tag in DROPPED, above.marked, above.region, above.articles + (tag == "article"), above.main or tag == "main")
        at.marked = (at.marked and not (tag in ("article", "main") and not above.articles)) or is_chrome(tag, attrs)
        if tag in REGIONS or tag in PARTS:
            self.regions += 1
            if tag in PARTS or at.articles or at.main:
                self.parent[self.regions] = above.region
            at.region = self.regions
        self.stack.append(at)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag in CELLS:
            self.parts.append(" ")
        self.pop_to(tag)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].dropped:
            self.parts.append(data)
            if self.open["a"] > 0:
                self.links += len(data)


def gaussian_smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian average with the kernel renormalised at both ends."""
    radius = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    n = len(values)
    out = []
    for i in range(n):
        lo, hi = max(0, i - radius), min(n, i + radius + 1)
        weights = kernel[lo - i + radius : hi - i + radius]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def two_cluster_threshold(values: list[float]) -> float:
    """Midpoint of two one-dimensional means; 0 if the values form one cluster."""
    low, high = min(values), max(values)
    if high <= 3 * low:
        return 0.0
    for _ in range(20):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not below or not above:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def read_lines(html: str) -> tuple[list[Line], dict[int, int]]:
    """Lines of a page, and the region around each region that goes with it."""
    html = _LONG_NUMBER.sub(lambda m: "&#" + (m[1] if len(m[1]) < 8 else "1114112"), html)
    reader = LineReader()
    try:
        reader.feed(html)
        reader.close()
    except AssertionError:  # a declaration that the parser can't read
        reader = LineReader()
        reader.feed(re.sub(r"<!(?!--)", "&lt;!", html))
        reader.close()
    reader.flush()
    return reader.lines, reader.parent


def faint(lines: list[Line]) -> list[bool]:
    """Which lines are marked, or outside of an article that holds most of the text."""
    inside = [True] * len(lines)
    total = sum(x.own for x in lines if not x.marked)
    for held in ([x.articles > 0 for x in lines], [x.main for x in lines]):
        if 2 * sum(x.own for x, h in zip(lines, held, strict=True) if h and not x.marked) >= max(1, total):
            inside = held
            break
    # An article within an article is a comment on it, if the outer one has a text to speak of.
    outer, every = (sum(x.own for x in lines if not x.marked and 0 < x.articles <= k) for k in (1, math.inf))
    nested = 4 * outer >= every > 0
    return [x.marked or not h or (nested and x.articles > 1) for x, h in zip(lines, inside, strict=True)]


def chosen(lines: list[Line], parent: dict[int, int], sigma: float = 1.0) -> list[Line]:
    """The lines of the regions that reach the threshold."""
    weak = faint(lines)
    ratios = [0.0 if f else x.own / max(1, x.tags) for x, f in zip(lines, weak, strict=True)]
    # A line counts for no more than its own ratio, whatever its neighbours lend it.
    values = [min(r, s) for r, s in zip(ratios, gaussian_smooth(ratios, sigma), strict=True)]
    cut = two_cluster_threshold(values)
    best: dict[int, float] = {}
    own, linked = Counter(), Counter()
    for x, v in zip(lines, values, strict=True):
        best[x.region] = max(best.get(x.region, 0.0), v)
        own[x.region] += x.own
        linked[x.region] += len(x.text) - x.own
    reached: dict[int, bool] = {}
    for region in sorted(best.keys() | parent.keys()):  # what is around a region has the smaller number
        reached[region] = best.get(region, 0.0) >= cut or (reached.get(parent.get(region, -1), False) and own[region] >= linked[region])
    return [x for x, f in zip(lines, weak, strict=True) if reached[x.region] and not (f and cut > 0)]


def closed(html: str) -> str:
    """The page without a long tail of tags or comments that begin and never end."""
    for begins, end in ((re.compile("<!--"), "-->"), (_BEGINS, ">")):
        tail = html.rfind(end) + len(end) if end in html else 0
        places = begins.finditer(html, tail)
        first = next(places, None)
        if first and sum(1 for _ in places) >= OPEN:
            html = html[: first.start()]
    return html


def extract(html: str | None, sigma: float = 1.0) -> tuple[str, int, int]:
    """(main text, kept lines, all lines) of one page."""
    lines, parent = read_lines(closed(html)) if html else ([], {})
    if not lines:
        return "", 0, 0
    kept = chosen(lines, parent, sigma)
    return "\n".join(x.text for x in kept), len(kept), len(lines)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", sigma: float = 1.0) -> DataFrame:
    """Add ``text_col``, ``n_chars``, ``kept_lines`` and ``all_lines`` to ``pages``."""

    @F.pandas_udf("text string, kept long, total long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for html in batches:
            yield pd.DataFrame([extract(h, sigma) for h in html], columns=["text", "kept", "total"])

    out = pages.withColumn("__x", run(F.col(html_col)))
    added = {text_col: F.col("__x.text"), "n_chars": F.length("__x.text").cast("long"), "kept_lines": F.col("__x.kept"), "all_lines": F.col("__x.total")}
    return out.withColumns(added).drop("__x")
