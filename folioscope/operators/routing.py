"""Routing of pages and regions to recognisers, and what native text is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx

TINY_POINTS = 7.0


def native_evidence(lines: DataFrame, keys: list[str], min_characters: int = 5, max_suspicious: float = 0.20, min_plausible: float = 0.50, min_coverage: float = 1e-5) -> DataFrame:
    """(keys, reliable, reason, ...) of a page's native lines: the first failing test names the reason.

    Wants text, box, width and height.  A page without lines has no row here.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    visible = F.length(F.regexp_replace(t, tx.SPACE, ""))
    page = lines.groupBy(*keys).agg(
        F.sum(visible).alias("characters"),
        F.sum(tx.suspicious_rate(t) * visible).alias("_odd"),
        F.sum(tx.count_matching(t, r"[\p{L}\p{N}]")).alias("_plausible"),
        F.sum(g.area(F.col("box"))).alias("_area"),
        F.max("width").alias("_w"),
        F.max("height").alias("_h"),
    )
    share = lambda c: F.when(F.col("characters") > 0, F.col(c) / F.col("characters")).otherwise(0.0)
    page = page.withColumns({"suspicious_rate": share("_odd"), "plausible_rate": share("_plausible"), "coverage": g.coverage(F.col("_area"), F.col("_w"), F.col("_h"))})
    reason = (
        F.when(F.col("characters") == 0, "no_native_text")
        .when(F.col("characters") < min_characters, "native_text_too_sparse")
        .when(F.col("suspicious_rate") > max_suspicious, "native_text_suspicious")
        .when(F.col("plausible_rate") < min_plausible, "native_text_implausible")
        .when(F.col("coverage") < min_coverage, "native_text_low_coverage")
        .otherwise("reliable_native_text")
    )
    return page.withColumn("reason", reason).withColumn("reliable", F.col("reason") == "reliable_native_text").drop("_odd", "_plausible", "_area", "_w", "_h")


def route_pages(pages: DataFrame, tiny_points: float = TINY_POINTS) -> DataFrame:
    """pages with ``needs_ocr``, ``route_reason`` and ``regions`` to recognise.

    Wants page_number, width, height, native_reliable, native_reason,
    image_regions, layout_regions (arrays of structs with box, block_type,
    text_type) and min_line_height, tiny_hint.  Reliable native text leaves only
    its pictures; else the layout's regions, or the whole page.
    """
    c = F.col
    tiny = F.coalesce(c("tiny_hint"), F.lit(False)) | F.coalesce((c("min_line_height") > 0) & (c("min_line_height") < tiny_points), F.lit(False))
    entry = lambda rid, b, kind, text, small: F.struct(rid.alias("region_id"), b.alias("box"), kind.alias("block_type"), text.alias("text_type"), small.alias("tiny_text"))
    name = lambda what, i: F.concat(F.lit("page-"), c("page_number"), F.lit(f"-{what}-"), i)
    pictures = F.transform("image_regions", lambda b, i: entry(name("image", i), b, F.lit("image"), F.lit("unknown"), F.lit(False)))
    layout = F.transform("layout_regions", lambda r, i: entry(name("layout", i), r.box, r.block_type, r.text_type, r.block_type == "tiny_text"))
    whole = F.array(entry(name("region", F.lit(0)), g.box(F.lit(0.0), F.lit(0.0), c("width"), c("height")), F.when(tiny, "tiny_text").otherwise("printed_text"), F.lit("unknown"), tiny))
    reliable, has_pictures, has_layout = F.coalesce(c("native_reliable"), F.lit(False)), F.size("image_regions") > 0, F.size("layout_regions") > 0
    return pages.withColumns(
        {
            "needs_ocr": ~reliable | has_pictures,
            "route_reason": F.when(reliable, F.when(has_pictures, "native_text_with_image_regions").otherwise("reliable_native_text")).when(has_layout, "layout_detected").otherwise(F.coalesce(F.nullif("native_reason", F.lit("")), F.lit("ocr_required"))),
            "regions": F.when(reliable, pictures).when(has_layout, layout).otherwise(whole),
        }
    )


def region_routes(block_type: Column, text_type: Column, hint: Column) -> Column:
    """Recognisers of a region in order: tables, then handwriting, then forms and mixed text (both), then text type."""
    h = F.lower(F.trim(F.coalesce(hint, F.lit(""))))
    routes = lambda *names: F.array(*(F.lit(n) for n in names))
    return (
        F.when((block_type == "table") | (h == "table"), routes("table"))
        .when((block_type == "handwriting") | (h == "handwriting"), routes("handwriting"))
        .when((block_type == "form") | (text_type == "mixed") | h.isin("form", "key_value", "key-value", "mixed"), routes("printed", "handwriting"))
        .when(text_type == "handwritten", routes("handwriting"))
        .otherwise(routes("printed"))
    )


def confident(lines: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, confident): some line, and all at the threshold; an unknown confidence is below it."""
    return lines.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("confidence") >= threshold, F.lit(False))).alias("confident"))


#: The block type of each label that providers use.
LABELS = {
    "title": "title",
    "heading": "title",
    "header": "header",
    "paragraph": "paragraph",
    "text": "paragraph",
    "body_text": "paragraph",
    "text_line": "text_line_group",
    "line": "text_line_group",
    "line_group": "text_line_group",
    "printed_text": "printed_text",
    "handwriting": "handwriting",
    "handwritten": "handwriting",
    "handwritten_text": "handwriting",
    "table": "table",
    "form": "form",
    "key_value": "form",
    "key-value": "form",
    "formula": "formula",
    "equation": "formula",
    "image": "image",
    "figure": "figure",
    "caption": "caption",
    "footer": "footer",
    "page_number": "page_number",
    "page-number": "page_number",
    "sidebar": "sidebar",
    "list": "list",
    "list_item": "list",
    "multi_column": "multi_column",
    "multi-column": "multi_column",
    "tiny_text": "tiny_text",
    "unknown": "unknown",
}
LOW_LAYOUT_CONFIDENCE = 0.5


def normalize_label(label: Column) -> Column:
    """A provider's label in lower case, its words and slashes joined by underscores; unknown for none."""
    tidy = F.regexp_replace(F.replace(F.lower(tx.strip(label)), F.lit("/"), F.lit("_")), f"{tx.SPACE}+", "_")
    return F.coalesce(F.nullif(tidy, F.lit("")), F.lit("unknown"))


def classify_labels(regions: DataFrame, label: str = "label", confidence: str = "confidence") -> DataFrame:
    """regions with block_type, route_hint, text_type, needs_review and flags by the provider's label.

    An unknown label is never taken for text: it needs review.
    """
    name, block = normalize_label(F.col(label)), F.lit(None).cast("string")
    for kind in dict.fromkeys(LABELS.values()):
        block = F.when(name.isin(*(x for x, k in LABELS.items() if k == kind)), kind).otherwise(block)
    out = regions.withColumn("_block", block)
    known, weak = F.col("_block").isNotNull(), F.coalesce(F.col(confidence) < LOW_LAYOUT_CONFIDENCE, F.lit(False))
    same = F.col("_block").isin("handwriting", "table", "form", "formula", "tiny_text", "unknown")
    one = lambda code: F.array(F.lit(code))
    return out.withColumns(
        {
            "block_type": F.coalesce("_block", F.lit("unknown")),
            "route_hint": F.when(~known, "unknown").when(same, F.col("_block")).when(F.col("_block").isin("image", "figure"), "image").otherwise("printed_text"),
            "text_type": F.when(F.col("_block") == "handwriting", "handwritten").when(~known | F.col("_block").isin("table", "form", "image", "figure", "unknown"), "unknown").otherwise("printed"),
            "needs_review": ~known | weak,
            "uncertainty_flags": F.when(~known, one("unknown_provider_class")).when(weak, one("low_layout_confidence")).otherwise(F.array().cast("array<string>")),
        }
    ).drop("_block")
