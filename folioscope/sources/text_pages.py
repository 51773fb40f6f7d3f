"""Texts as logical pages of lines with a synthetic geometry."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..functions.text import each_text
from .detect import split_lines

WIDTH = 612.0
PITCH = 18.0
MARGIN = 36.0
LINE_HEIGHT = 14.0
#: Lines of a page at the default page height limit.
PAGE_LINES = 2773
BREAKING = frozenset("br p div li tr h1 h2 h3 h4".split())


class _Visible(HTMLParser):
    def __init__(self, skip: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.hidden = skip, 0

    def handle_starttag(self, tag, attrs):
        if self.skip and tag in ("script", "style"):
            self.hidden += 1
        if tag in BREAKING:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.skip and tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in BREAKING and tag != "br":
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.out.append(data.strip())


def visible_text(html: Column, skip_raw_elements: bool = False) -> Column:
    """Text of a page with a line end at block tags.

    Scripts and styles are part of it unless ``skip_raw_elements`` (Arrow UDF
    over the standard parser: markup is not a regular language).
    """

    def one(page: str) -> str:
        parser = _Visible(skip_raw_elements)
        parser.feed(page)
        parser.close()
        return "".join(parser.out)

    return each_text(html, one)


def lines(df: DataFrame, key: str, text: str, page_lines: int = PAGE_LINES) -> DataFrame:
    """(key, page_number, line_index, text) of every line, blank ones too; an empty text has one empty line."""
    parts = split_lines(F.coalesce(F.col(text), F.lit("")))
    parts = F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)
    out = df.select(key, F.posexplode(parts).alias("_pos", "text"))
    return out.select(key, (F.floor(F.col("_pos") / page_lines) + 1).cast("int").alias("page_number"), (F.col("_pos") % page_lines).cast("int").alias("line_index"), "text")


def pages(df: DataFrame, key: str, text: str, page_lines: int = PAGE_LINES) -> DataFrame:
    """(key, page_number, n_lines, native_lines, characters, width, height, coverage) of every logical page.

    Pages follow from the number of lines, so nothing is shuffled.
    """
    parts = split_lines(F.coalesce(F.col(text), F.lit("")))
    parts = F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)
    page = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / page_lines).cast("int")), lambda k: F.slice(F.col("_lines"), k * page_lines + 1, F.lit(page_lines)))).alias("_p", "_page")
    out = df.select(key, parts.alias("_lines")).select(key, page)
    blank = lambda x: F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    native = F.size(F.filter("_page", lambda x: blank(x) != ""))
    n = F.size("_page")
    height = F.greatest(F.lit(792.0), 72.0 + n * PITCH)
    characters = F.aggregate(F.transform("_page", lambda x: F.length(blank(x))), F.lit(0), lambda a, b: a + b)
    return out.select(
        key,
        (F.col("_p") + 1).alias("page_number"),
        n.alias("n_lines"),
        native.alias("native_lines"),
        characters.alias("characters"),
        F.lit(WIDTH).alias("width"),
        height.alias("height"),
        F.least(F.lit(1.0), native * LINE_HEIGHT * (WIDTH - 2 * MARGIN) / (WIDTH * height)).alias("coverage"),
    )


def line_box(index: Column) -> Column:
    """Box of the line with an index on its page."""
    top = MARGIN + index * PITCH
    return box(F.lit(MARGIN), top, F.lit(WIDTH - MARGIN), top + LINE_HEIGHT)


def native_lines(lined: DataFrame) -> DataFrame:
    """Lines with text, with their box; they keep their index."""
    return lined.where(F.length(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", "")) > 0).withColumn("box", line_box(F.col("line_index")))
