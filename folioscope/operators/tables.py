"""Table cells: validation that drops and never repairs, addresses from centres, grids from words.

Checks that look at one cell are columns.  Whether a cell repeats an accepted
one depends on the order, so that step runs a table at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from .groups import doubles, sequential

#: A table with more empty cells than this is not usable.
MAX_EMPTY = 0.75
#: Cells that overlap the smaller one by this share are the same.
SAME_CELL = 0.90
CHECKED = "region_id string, cell_idx long, row long, column long, accepted boolean, warning string"


def stateless_warning(b: Column, width: Column, height: Column) -> Column:
    """First failing check of a cell by itself; null if all hold."""
    region_ok = (width > 0) & (height > 0)
    odd = F.lit(False)
    for p in (b.x0, b.y0, b.x1, b.y1):
        odd = odd | p.isNull() | F.isnan(p)
    shape = odd | (b.x0 < 0) | (b.y0 < 0) | (b.x1 <= b.x0) | (b.y1 <= b.y0) | (b.x1 > width) | (b.y1 > height)
    polygon = F.col("polygon")
    points_ok = polygon.isNull() | ((F.size(polygon) >= 3) & F.forall(polygon, lambda p: (p.x >= 0) & (p.y >= 0) & (p.x <= width) & (p.y <= height)) & (F.abs(g.signed_area(polygon)) > 0))
    address = F.col("row").isNull() | F.col("column").isNull() | (F.col("row") < 0) | (F.col("column") < 0)
    confidence = F.col("confidence").isNotNull() & ~F.col("confidence").between(0.0, 1.0)
    return (
        F.when(~F.coalesce(region_ok, F.lit(False)), "invalid_region_geometry")
        .when(address, "invalid_address")
        .when(shape | ~points_ok, "invalid_geometry")
        .when(F.col("text").isNull(), "invalid_text")
        .when(confidence, "invalid_confidence")
    )


def check_cells(cells: DataFrame) -> DataFrame:
    """(region_id, cell_idx, row, column, accepted, warning) for every cell.

    Wants region_id, region_width, region_height, cell_idx, row, column, text,
    bbox, polygon and confidence.
    """
    return _checked(cells).select("region_id", "cell_idx", "row", "column", "accepted", "warning")


def _checked(cells: DataFrame) -> DataFrame:
    """Every cell once, as ``check_cells``, with the corner and ``filled`` that its table needs."""
    filled = F.lit(None).cast("boolean") if "raw_text" not in cells.columns else F.trim(F.coalesce("raw_text", "text")) != ""
    one = cells.withColumn("_warning", stateless_warning(F.col("bbox"), F.col("region_width"), F.col("region_height")))
    slim = one.select(F.col("region_id").cast("string").alias("region_id"), F.col("cell_idx").cast("long").alias("cell_idx"), F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", "_warning", filled.alias("filled"))

    def in_order(table: list[dict]) -> list[tuple]:
        taken: set[tuple[int, int]] = set()
        boxes: list[tuple[float, float, float, float]] = []
        out = []
        for c in table:
            warning, address, b = c["_warning"], (c["row"], c["column"]), (c["x0"], c["y0"], c["x1"], c["y1"])
            if warning is None and address in taken:
                warning = "duplicate_address"
            if warning is None and any(_overlap(b, other) >= SAME_CELL for other in boxes):
                warning = "overlapping_duplicate"
            if warning is None:
                taken.add(address)
                boxes.append(b)
            out.append((c["region_id"], c["cell_idx"], c["row"], c["column"], warning is None, warning, c["y0"], c["x0"], c["filled"]))
        return out

    def all_in_order(rows: pa.Table, at: np.ndarray) -> pa.Table:
        # A cell without a warning has an address and ordered corners.
        row, column = (pc.fill_null(rows.column(c), -1).to_numpy()[at] for c in ("row", "column"))
        x0, y0, x1, y1 = (doubles(rows, c)[at] for c in ("x0", "y0", "x1", "y1"))
        fine = pc.is_null(rows.column("_warning")).to_numpy()[at]
        repeated, overlapping = np.zeros(at.shape, bool), np.zeros(at.shape, bool)
        for i in range(1, at.shape[1]):
            b, before = slice(i, i + 1), slice(0, i)
            repeated[:, i] = fine[:, i] & (fine[:, before] & (row[:, b] == row[:, before]) & (column[:, b] == column[:, before])).any(1)
            shared = np.maximum(0.0, np.minimum(x1[:, b], x1[:, before]) - np.maximum(x0[:, b], x0[:, before])) * np.maximum(0.0, np.minimum(y1[:, b], y1[:, before]) - np.maximum(y0[:, b], y0[:, before]))
            least = np.minimum((x1[:, b] - x0[:, b]) * (y1[:, b] - y0[:, b]), (x1[:, before] - x0[:, before]) * (y1[:, before] - y0[:, before]))
            share = np.divide(shared, least, out=np.zeros(shared.shape), where=least > 0)
            overlapping[:, i] = fine[:, i] & ~repeated[:, i] & (fine[:, before] & (share >= SAME_CELL)).any(1)
            fine[:, i] &= ~(repeated[:, i] | overlapping[:, i])
        out = rows.take(at.ravel())
        warning = pc.if_else(pa.array(repeated.ravel()), "duplicate_address", pc.if_else(pa.array(overlapping.ravel()), "overlapping_duplicate", out.column("_warning")))
        return out.append_column("accepted", pa.array(fine.ravel())).append_column("warning", warning)

    # Cells of one index are told apart by address and box, so that the result does not hang on the shuffle.
    order = ["cell_idx", "row", "column", "y0", "x0", "y1", "x1", "_warning", "filled"]
    return sequential(slim, ["region_id"], order, in_order, f"{CHECKED}, y0 double, x0 double, filled boolean", all_in_order)


def _overlap(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    least = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return max(0.0, w) * max(0.0, h) / least if least > 0 else 0.0


def validate(cells: DataFrame) -> DataFrame:
    """One row per table: accepted cells in row order, warnings, review flags, and whether it is usable."""
    ok = F.col("accepted")
    listed = F.struct("row", "column", "y0", "x0", "cell_idx")
    out = _checked(cells).groupBy("region_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(ok, listed))), lambda c: F.struct(c.row.alias("row"), c.column.alias("column"), c.cell_idx.alias("cell_idx"))).alias("cells"),
        F.count_if(ok).alias("n_cells"),
        F.count_if(ok & F.col("filled")).alias("n_filled"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("cell_idx", "warning")))), lambda w: w.warning).alias("warnings"),
    )
    empty, sparse = F.col("n_cells") == 0, (F.col("n_cells") - F.col("n_filled")) / F.col("n_cells") > MAX_EMPTY
    one = lambda code: F.array(F.lit(code))
    none = F.array().cast("array<string>")
    out = out.withColumn("warnings", F.concat("warnings", F.when(empty, one("empty_result")).when(sparse, one("excessive_empty_cells")).otherwise(none)))
    geometry = F.exists("warnings", lambda w: w.isin("invalid_geometry", "invalid_region_geometry"))
    flags = F.array_compact(F.array(F.when(geometry, F.lit("invalid_geometry")), F.when(F.size("warnings") > 0, F.lit("table_structure_uncertain"))))
    return out.withColumn("flags", flags).withColumn("usable", (F.col("n_filled") > 0) & ~F.coalesce(sparse, F.lit(False)))


def provider_confidence(value: Column) -> Column:
    """A printed-text provider's confidence: outside 0 to 1 it is unknown, never rescaled."""
    return F.when(value.between(0.0, 1.0), value)


def table_confidence(value: Column) -> Column:
    """A table provider's confidence: percentages are scaled, the rest is clamped."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(value > 1, value / 100).otherwise(value)))


def infer_addresses(cells: DataFrame, key: str = "region_id") -> DataFrame:
    """cells with row and column from given indices or, where missing, the nearest clustered centre.

    Centres join a cluster within half the current cell's size, in order, so a table is one group.
    """
    kept = [c for c in cells.columns if c not in ("row", "column")]
    schema = T.StructType([*(cells.schema[c] for c in kept), T.StructField("row", T.LongType()), T.StructField("column", T.LongType())])

    def assign(table: list[dict]) -> list[tuple]:
        found = {}
        for name, low, high in (("row", "y0", "y1"), ("column", "x0", "x1")):
            middle = [(c[low] + c[high]) / 2 for c in table]
            clusters: list[list[float]] = []
            for m, reach in sorted((m, (c[high] - c[low]) / 2) for m, c in zip(middle, table)):
                near = next((x for x in clusters if abs(sum(x) / len(x) - m) <= max(reach, 1e-9)), None)
                clusters.append([m]) if near is None else near.append(m)
            centres = sorted(sum(x) / len(x) for x in clusters)
            found[name] = [int(c[name]) if c.get(name) is not None else min(range(len(centres)), key=lambda k, m=m: abs(centres[k] - m)) for m, c in zip(middle, table)]
        return [(*(c[k] for k in kept), r, n) for c, r, n in zip(table, found["row"], found["column"])]

    return sequential(cells, [key], [], assign, schema)


def words_to_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words with a recogniser's block, paragraph and line numbers as lines: text in word order, box, mean confidence.

    Confidences are percentages; negative ones are unknown.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("word", F.trim("text").alias("t")))))
    return words.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda w: w.t), " ").alias("text"),
        g.box(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bbox"),
        (F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))) / 100).alias("confidence"),
        F.count(F.lit(1)).alias("n_words"),
    )
