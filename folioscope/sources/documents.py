"""From detected files to pages and lines: each file goes to the reader of its content type.

All readers give the same rows, so what follows does not ask where a line came
from.  Files whose type needs a renderer or a model (PDF, pictures, legacy
spreadsheets) are problems here, unless rows of an adapter are given for them.

Edge cases: an empty, unreadable or unknown file is a problem row with its
code; a text without lines is one page with one empty line; JSON that does not
parse is a problem; a repeated path is read each time it is there.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import routing
from . import detect, office, text_pages


class Read(NamedTuple):
    """Pages (path, page_number, width, height, page_type, reason, n_lines, pictures), lines, and problems (path, code)."""

    pages: DataFrame
    lines: DataFrame
    problems: DataFrame


LINE = ("path", "page_number", "block_index", "line_index", "text", "x0", "y0", "x1", "y1")


def _texts(files: DataFrame) -> DataFrame:
    """Text files with their visible text; null for what is no text of its type."""
    raw = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    html = F.col("content_type") == "text/html"
    texts = files.where(F.col("content_type").isin(*detect.TEXT_TYPES)).withColumn("_raw", F.when(valid, raw))
    # Only markup reaches the Python step.
    texts = texts.withColumn("_visible", text_pages.visible_text(F.when(html, F.col("_raw"))))
    json = (F.col("content_type") == "application/json") & F.try_parse_json("_raw").isNull()
    return texts.select("path", F.when(html, F.col("_visible")).when(~json, F.col("_raw")).alias("_text"))


def read(files: DataFrame, page_lines: int = text_pages.PAGE_LINES) -> Read:
    """Reads files (path, content, content_type, type_error), as ``detect.detect`` gives them."""
    texts = _texts(files.where("type_error is null"))
    good = texts.where("_text is not null")
    lined = text_pages.native_lines(text_pages.lines(good, "path", "_text", page_lines))
    text_lines = lined.select("path", "page_number", F.lit(0).alias("block_index"), "line_index", "text", *(F.col(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))
    text_pages_ = text_pages.pages(good, "path", "_text", page_lines).select(
        "path", F.col("page_number").cast("int"), "width", F.col("height").cast("double"), F.lit("native_text").alias("page_type"), F.lit("logical_text_page").alias("reason"), F.col("native_lines").cast("long").alias("n_lines"), F.lit(0).cast("long").alias("pictures")
    )
    parts = office.read_parts(files.where("type_error is null"))
    office_lines = parts.where("text is not null and not picture").select(F.col("key").alias("path"), *LINE[1:])
    office_pages = parts.where("page_number is not null").groupBy(F.col("key").alias("path"), "page_number").agg(
        F.first("width").alias("width"), F.first("height").alias("height"), F.when(F.count_if("picture") > 0, "mixed").otherwise("native_text").alias("page_type"),
        F.first("reason").alias("reason"), F.count_if(~F.col("picture")).alias("n_lines"), F.count_if("picture").alias("pictures"),
    )
    known = F.col("content_type").isin(*detect.TEXT_TYPES, *detect.CONTAINERS.values())
    problems = files.where("type_error is not null").select("path", F.col("type_error").alias("code"))
    problems = problems.unionByName(files.where(F.col("type_error").isNull() & ~known).select("path", F.lit("adapter_required").alias("code")))
    problems = problems.unionByName(texts.where("_text is null").select("path", F.lit("invalid_document").alias("code")))
    problems = problems.unionByName(parts.where("error is not null").select(F.col("key").alias("path"), F.lit("malformed_office").alias("code")))
    return Read(text_pages_.unionByName(office_pages), text_lines.unionByName(office_lines), problems)


def warnings(found: Read) -> DataFrame:
    """(path, page_number, code, severity, message) of the pages whose native text is not reliable; pages without text are silent."""
    lines = found.lines.join(found.pages.select("path", "page_number", "width", "height"), ["path", "page_number"])
    evidence = routing.native_evidence(lines.withColumn("box", F.struct("x0", "y0", "x1", "y1")), ["path", "page_number"])
    return evidence.where("not reliable and reason <> 'no_native_text'").select("path", "page_number", F.lit("native_text_unreliable").alias("code"), F.lit("warning").alias("severity"), F.col("reason").alias("message"))
