"""Page layout: column groups, paragraphs, runs, reading order.

Intervals are grouped by running maxima over windows of one page; only the
rows with a moving centre need a sequential step, a page at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from .groups import doubles, sequential

LEADING = ("title", "header")
TRAILING = ("footer", "page_number")


def column_groups(intervals: DataFrame, keys: list[str], x0: str, x1: str, width: Column, ratio: float = 0.08) -> DataFrame:
    """intervals with ``column_group`` from 0: a new group begins where the gap to all before is over max(8, ratio * width)."""
    before = Window.partitionBy(*keys).orderBy(x0, x1).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys).orderBy(x0, x1).rowsBetween(Window.unboundedPreceding, 0)
    gap = F.greatest(F.lit(8.0), width * ratio)
    opens = F.when(F.col(x0) - F.max(x1).over(before) > gap, 1).otherwise(0)
    return intervals.withColumn("_opens", opens).withColumn("column_group", F.sum("_opens").over(so_far).cast("int")).drop("_opens")


def paragraphs(lines: DataFrame, keys: list[str], order: list[str], y0: str, y1: str) -> DataFrame:
    """lines with ``paragraph`` from 0: a new one where the gap is over max(12, 2.5 * the higher of both lines)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    top, bottom = F.lag(y0).over(w), F.lag(y1).over(w)
    height = F.greatest(bottom - top, F.col(y1) - F.col(y0))
    opens = F.when(F.col(y0) - bottom > F.greatest(F.lit(12.0), height * 2.5), 1).otherwise(0)
    return lines.withColumn("_opens", opens).withColumn("paragraph", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_opens")


def active_runs(profile: DataFrame, keys: list[str], index: str, value: str, threshold: float, gap: int) -> DataFrame:
    """(keys, run_start, run_end) of indices with value >= threshold, joined over gaps of at most ``gap``; end is exclusive."""
    w = Window.partitionBy(*keys).orderBy(index)
    active = profile.where(F.col(value) >= threshold).withColumn("_opens", F.when(F.col(index) - F.lag(index).over(w) > gap + 1, 1).otherwise(0))
    runs = active.withColumn("_run", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(index).alias("run_start"), (F.max(index) + 1).alias("run_end")).drop("_run")


def reading_order(regions: DataFrame, keys: list[str], tie: str | None = None) -> DataFrame:
    """regions with ``reading_order`` from 0 on each page.

    Wants x0, y0, x1, y1, block_type, page_width and direction.  Titles and
    headers come first, then the body by columns, sidebars, footers and page
    numbers; right to left, columns and lines run from the right.  A mixed page
    reads as left to right.  ``tie`` orders regions that begin at one point.
    """
    band = F.when(F.col("block_type").isin(*LEADING), 0).when(F.col("block_type") == "sidebar", 2).when(F.col("block_type").isin(*TRAILING), 3).otherwise(1)
    with_band = regions.withColumn("_band", band)
    grouped = column_groups(with_band, [*keys, "_band"], "x0", "x1", F.col("page_width"))
    spans = Window.partitionBy(*keys, "_band", "column_group")
    grouped = grouped.withColumns({"_g0": F.min("x0").over(spans), "_g1": F.max("x1").over(spans)})
    rtl = F.lower("direction") == "rtl"
    column = F.when(F.col("_band") == 1, F.when(rtl, -F.col("column_group")).otherwise(F.col("column_group"))).otherwise(0)
    w = Window.partitionBy(*keys).orderBy("_band", "_column", "y0", F.when(rtl, -F.col("x1")).otherwise(F.col("x0")), "x0", *([tie] if tie else []))
    return grouped.withColumn("_column", column).withColumn("reading_order", F.row_number().over(w) - 1).drop("_band", "_g0", "_g1", "_column", "column_group")


def column_count(regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, columns) of the body, one at least."""
    body = ~F.col("block_type").isin(*LEADING, *TRAILING)
    grouped = column_groups(regions.where(body), keys, "x0", "x1", F.col("page_width")).groupBy(*keys).agg((F.max("column_group") + 1).alias("_n"))
    return regions.select(*keys).distinct().join(grouped, keys, "left").select(*keys, F.coalesce("_n", F.lit(1)).alias("columns"))


def block_type_of_native(y0: Column, y1: Column, x0: Column, x1: Column, lines: Column, text: Column, width: Column, height: Column) -> Column:
    """Type of a native text block by its place on the page."""
    digits = F.trim(text).rlike(r"(?U)^\d+$")
    return (
        F.when(y0 <= height * 0.20, F.when((lines == 1) & (x1 - x0 < width * 0.8), "title").otherwise("header"))
        .when(y1 >= height * 0.86, F.when((lines == 1) & digits, "page_number").otherwise("footer"))
        .otherwise(F.when(lines > 1, "paragraph").otherwise("text_line_group"))
    )


def block_type_of_pixels(y0: Column, y1: Column, x0: Column, x1: Column, lines: Column, width: Column, height: Column, median_height: Column) -> Column:
    """Type of a block found in pixels by its place, width and height."""
    wide = x1 - x0
    centred = F.abs((x0 + x1) / 2 - width / 2) <= width * 0.12
    return (
        F.when(y0 <= height * 0.12, F.when((lines == 1) & wide.between(width * 0.30, width * 0.80) & (y1 - y0 > median_height * 1.4), "title").otherwise("header"))
        .when(y1 >= height * 0.86, F.when((lines == 1) & (wide <= width * 0.25) & centred, "page_number").otherwise("footer"))
        .otherwise(F.when(lines > 1, "paragraph").otherwise("text_line_group"))
    )


def normalize_regions(regions: DataFrame) -> DataFrame:
    """regions with ``bbox`` and ``polygon`` inside the page and ``problem``, null where the geometry stands.

    Wants bbox, polygon, page_width, page_height and confidence.  A polygon's
    bounds replace the box.
    """
    w, h = F.col("page_width"), F.col("page_height")
    polygon = g.clip_polygon_points(F.col("polygon"), w, h)
    out = regions.withColumns({"_clip": g.clip(F.col("bbox"), w, h), "_polygon": polygon})
    broken = F.when((w <= 0) | (h <= 0), "page_size").when(F.col("polygon").isNotNull() & F.col("_polygon").isNull(), "polygon").when(F.col("confidence").isNotNull() & ~F.col("confidence").between(0.0, 1.0), "confidence")
    out = out.withColumn("problem", F.coalesce(broken, "_clip.problem"))
    return out.withColumns({"bbox": F.coalesce(F.when(F.col("_polygon").isNotNull(), g.polygon_box(F.col("_polygon"))), F.col("_clip.box")), "polygon": F.col("_polygon")}).drop("_clip", "_polygon")


def words_in_rows(words: DataFrame, key: str) -> DataFrame:
    """(key, line_index, text, confidence, x0, y0, x1, y1): words joined to the latest line whose centre is near enough.

    Near is 0.7 of the higher of word and line; centres move as words join, so a page's words are taken in order.
    """

    def join(page: list[dict]) -> list[tuple]:
        lines: list[list[dict]] = []
        centre = lambda ws: sum((w["y0"] + w["y1"]) / 2 for w in ws) / len(ws)
        tall = lambda ws: max(max(1.0, w["y1"] - w["y0"]) for w in ws)
        for word in page:
            line = next((ws for ws in reversed(lines) if abs(centre([word]) - centre(ws)) <= 0.7 * max(tall([word]), tall(ws))), None)
            lines.append([word]) if line is None else line.append(word)
        out = []
        for k, ws in enumerate(lines):
            ws.sort(key=lambda w: w["x0"])
            known = [w["confidence"] for w in ws if w["confidence"] is not None]
            out.append((str(page[0][key]), k, " ".join(w["text"] for w in ws), sum(known) / len(known) if known else None, min(w["x0"] for w in ws), min(w["y0"] for w in ws), max(w["x1"] for w in ws), max(w["y1"] for w in ws)))
        return out

    return sequential(words, [key], ["y0", "x0"], join, f"{key} string, line_index int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")


def gate_confidence(confidence: Column, threshold: float = 0.35) -> Column:
    """Whether a layout region needs review for its confidence."""
    return F.coalesce(confidence < threshold, F.lit(False))


def reading_rows(lines: DataFrame, key: str, direction: str = "direction", tolerance: float = 8.0) -> DataFrame:
    """lines with ``row_order`` from 0 on each page: rows within ``tolerance`` of a running mean centre.

    The centre moves as lines join, so a page's lines are taken in order, in one
    group; a page is bounded, and pages are independent.
    """
    schema = T.StructType([*lines.schema.fields, T.StructField("row_order", T.IntegerType())])
    names = lines.columns

    def place(page: list[dict]) -> list[tuple]:
        sums: list[list[float]] = []
        row_of = []
        for line in page:
            middle = (line["y0"] + line["y1"]) / 2
            near = next((k for k, (total, n) in enumerate(sums) if abs(middle - total / n) <= tolerance), None)
            if near is None:
                near = len(sums)
                sums.append([0.0, 0])
            sums[near][0] += middle
            sums[near][1] += 1
            row_of.append(near)
        centre = [total / n for total, n in sums]
        sign = -1 if str(page[0][direction]).lower() == "rtl" else 1
        order = sorted(range(len(page)), key=lambda i: (centre[row_of[i]], row_of[i], sign * page[i]["x0"]))
        return [(*(page[i][c] for c in names), k) for k, i in enumerate(order)]

    def place_all(rows: pa.Table, at: np.ndarray) -> pa.Table:
        groups, size = at.shape
        each = np.arange(groups)
        middle = (doubles(rows, "y0")[at] + doubles(rows, "y1")[at]) / 2
        total, n, row_of, opened = np.zeros(at.shape), np.zeros(at.shape), np.zeros(at.shape, int), np.zeros(groups, int)
        for i in range(size):
            near = (np.abs(middle[:, i : i + 1] - total[:, : i + 1] / np.maximum(n[:, : i + 1], 1)) <= tolerance) & (n[:, : i + 1] > 0)
            k = np.where(near.any(1), near.argmax(1), opened)
            opened += k == opened
            total[each, k] += middle[:, i]
            n[each, k] += 1
            row_of[:, i] = k
        centre = np.take_along_axis(total / np.maximum(n, 1), row_of, 1)
        sign = np.array([-1.0 if str(d).lower() == "rtl" else 1.0 for d in rows.column(direction).take(at[:, 0]).to_pylist()])
        order = np.lexsort(((sign[:, None] * doubles(rows, "x0")[at]).ravel(), row_of.ravel(), centre.ravel(), np.repeat(each, size)))
        return rows.take(at.ravel()[order]).append_column("row_order", pa.array(np.tile(np.arange(size, dtype=np.int32), groups)))

    # Equal corners are told apart by the other columns, so that the order does not hang on the shuffle.
    ties = [c for c in names if c not in (key, "y0", "x0") and not isinstance(lines.schema[c].dataType, T.MapType)]
    return sequential(lines, [key], ["y0", "x0", *ties], place, schema, place_all, ("x0", "y0", "y1"))
