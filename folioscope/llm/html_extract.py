"""Main text of web pages from streamed parser events: text-to-tag ratios, smoothed and clustered.

The standard library's parser feeds events; each block-level tag ends a line.
A line has its text, its tags and the names it stands under.  Its ratio is
characters of text to tags; the ratios are smoothed by a Gaussian along the
page, and a threshold (from their two-means clustering) parts content from
the rest.  Lines inside menus, headers, footers, sidebars, notices, adverts,
forms and reader comments have ratio nothing and are never content.  Regions
grow from every content line: over the short lines between it and the next one
unless a barred line parts them, and over the running-text blocks next to it up
to a barred line (inside a marked article past it, where it is an insertion).

Edge cases: null and empty pages, and pages without text, give an empty text;
broken markup is read as far as the parser goes; repeated rows give equal
texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

#: HTML's void elements, its usual block elements, and elements without main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("head script style noscript template nav footer aside form button select option textarea input label iframe object svg canvas audio video dialog menu title datalist".split())
#: Words in class, id and role that mark what isn't main text.
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|alert\w*|dialog|adsense|adslot|banner|billboard|breadcrumbs?|comments?|commentlist|commentary|consent|contentinfo|complementary|cookies?|copyright|discuss\w*|disqus|footer|gdpr|header|masthead|menu\w*|modal|nav\w*|newsletter|notice|notification|overlay|logo|brand|tagline|pagination|pager|paywall|popup|promo\w*|recommend\w*|related|replies|reply|respond|rss|search|share|sharing|sidebar|side|signup|skip|social|sponsor\w*|subscribe|subscription|tags?|toolbar|tooltip|topbar|widget)\d*(?:$|[\s_-])",
    re.I,
)
#: Inside an article an id is mostly the slug of a heading; only these words of it mark what isn't main text.
_BAD_ID = re.compile(r"(?:^|[\s_-])(?:ads?|comments?|disqus|footer|menu|nav|navbar|newsletter|respond|sidebar)(?:$|[\s_-])", re.I)
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: What says that an element stands beside something, or heads the article itself.
_BESIDE = re.compile(r"\b(?:has|no|with|without|show|hide|is)[_-][\w-]+|\b(?:article|entry|post|story)[_-](?:header|masthead|tags?)\b", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|main|post|story)(?:$|[\s_-])", re.I)
_BODY = re.compile(r"(?:^|[\s_-])(?:article(?:[\s_-]?(?:body|content|text))?|articlebody|entry-content|post-content|post-body|story-body|main-content)(?:$|\s)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Blocks of running text, which a region takes in next to its content lines.
RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre figcaption dd dt td th".split())
#: Elements that an end tag of an outer block closes, and that close each other.
_CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


class Line(NamedTuple):
    """Text between two block-level tags."""

    text: str
    tags: int
    barred: bool
    article: bool
    block: str
    linked: float

    def ratio(self) -> float:
        """Characters to tags, without those of links; nothing for barred lines."""
        return 0.0 if self.barred else len(self.text) * (1 - self.linked) / max(1, self.tags)


class _Lines(HTMLParser):
    """Collects lines from the events of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # name, barred, in article, silent
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.link_chars = self.chars = 0
        self.barred = self.article = self.silent = False
        self.open: Counter[str] = Counter()

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                block = next((x[0] for x in reversed(self.stack) if x[0] in BLOCK), "")
                self.lines.append(Line(text, self.tags, self.barred, self.article, block, self.link_chars / max(1, self.chars)))
                self.tags = 0
            self.parts = []
            self.link_chars = self.chars = 0

    def _top(self) -> None:
        self.barred, self.article, self.silent = self.stack[-1][1:] if self.stack else (False, False, False)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
            while self.stack and (self.stack[-1][0] == "p" or tag in _CLOSES.get(self.stack[-1][0], ())):
                if self.stack[-1][0] == "p" and tag not in BLOCK:
                    break
                self.open[self.stack.pop()[0]] -= 1
                self._top()
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
            return
        barred = self.barred or tag in NEVER
        article = self.article or tag in ("article", "main")
        if attrs and tag not in ("html", "body"):
            named = slug = ""
            for key, value in attrs:
                if key == "id" and article and self.article:
                    slug = value or ""
                elif key in ("class", "id", "role", "itemprop"):
                    named += f" {value or ''}"
                elif key == "hidden" or key == "style" and value and _HIDDEN.search(value) or key == "aria-hidden" and value == "true":
                    barred = True
            if slug and tag not in _HEADINGS and _BAD_ID.search(_CAMEL.sub("-", slug)):
                barred = True
            if named:
                named = _BESIDE.sub("", _CAMEL.sub("-", named))
                if _BODY.search(named):
                    article = True
                if _BAD.search(named) and not (_GOOD.search(named) and tag in ("article", "main")):
                    barred = True
        if tag == "header" and not self.article:
            barred = True
        # An inline element that is barred inside a line that isn't: its text is left out of the line.
        silent = self.silent or (tag not in BLOCK and barred and not self.barred)
        self.stack.append((tag, barred, article, silent))
        self.open[tag] += 1
        self.barred, self.article, self.silent = barred, article, silent

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        self.tags += 1
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                self.open.subtract(x[0] for x in self.stack[k:])
                del self.stack[k:]
                self._top()
                return
            if tag not in BLOCK and name in BLOCK:
                return  # an inline end tag does not close a block

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.parts.append(data)
        self.chars += len(data)
        if self.open["a"]:
            self.link_chars += len(data)

    def close(self) -> None:
        super().close()
        self._flush()


def lines_of(html: str) -> list[Line]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    return parser.lines


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; past the ends, the kernel is renormalised."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(values, kernel, "full")[radius : radius + len(values)] / np.convolve(np.ones(len(values)), kernel, "full")[radius : radius + len(values)]


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """Boundary between two clusters of the smoothed ratios (two-means on their square roots)."""
    x = np.sqrt(values)
    low, high = float(x.min()), float(x.max())
    if high - low < 1e-9:
        return 0.0
    for _ in range(rounds):
        cut = (low + high) / 2
        below, above = x[x < cut], x[x >= cut]
        now = (float(below.mean()) if len(below) else low, float(above.mean()) if len(above) else high)
        if now == (low, high):
            break
        low, high = now
    return ((low + high) / 2) ** 2


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The page's main text, a line for each block."""
    lines = lines_of(html or "")
    if not any(not x.barred for x in lines):
        return ""
    ratios = np.array([x.ratio() for x in lines])
    level = smooth(ratios, sigma)
    content = (level >= threshold(level)) & (ratios > 0)
    taken = content.copy()
    at = np.flatnonzero(content).tolist()
    for a, b in zip(at, at[1:]):
        if not any(lines[k].barred for k in range(a + 1, b)):
            taken[a:b] = True
    for edge in at:
        for way in (-1, 1):
            k = edge + way
            while 0 <= k < len(lines) and not taken[k]:
                if lines[k].barred:
                    if not (lines[k].article and lines[edge].article):
                        break
                elif lines[k].block in RUNNING and lines[k].linked < 0.5:
                    taken[k] = True
                else:
                    break
                k += way
    return "\n".join(x.text for x, c in zip(lines, taken) if c and not x.barred)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text_col: str = "text") -> DataFrame:
    """``keep`` and the main text of every page; no shuffle."""
    small_batches(df.sparkSession)
    kept = [c for c in keep if c != text_col]
    src = df.select(*kept, df[html_col].alias("__html"))
    schema = T.StructType([*src.select(*kept).schema.fields, T.StructField(text_col, T.StringType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, text_col])

    return src.mapInArrow(run, schema)
