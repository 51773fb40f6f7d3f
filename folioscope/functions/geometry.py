"""Boxes, polygons and plane mappings as columns.

A box is a struct of doubles x0, y0, x1, y1; a polygon an array of structs x, y;
a mapping nine doubles, row by row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))))


def area(b: Column) -> Column:
    return (b.x1 - b.x0) * (b.y1 - b.y0)


def valid_box(b: Column) -> Column:
    """Ordered corners that are not negative; an empty area is allowed."""
    return (b.x0 >= 0) & (b.y0 >= 0) & (b.x0 <= b.x1) & (b.y0 <= b.y1)


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * F.greatest(zero, F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union <= 0, 0.0).otherwise(shared / union)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 where that is empty."""
    least = F.least(area(a), area(b))
    return F.when(least <= 0, 0.0).otherwise(intersection(a, b) / least)


def inside(inner: Column, outer: Column) -> Column:
    return (inner.x0 >= outer.x0) & (inner.y0 >= outer.y0) & (inner.x1 <= outer.x1) & (inner.y1 <= outer.y1)


def within(b: Column, width: Column, height: Column) -> Column:
    return (b.x1 <= width) & (b.y1 <= height)


def union_of(b: Column) -> Column:
    """Aggregate: the smallest box around all."""
    return box(F.min(b.x0), F.min(b.y0), F.max(b.x1), F.max(b.y1))


def clip(b: Column, width: Column, height: Column) -> Column:
    """Struct (box, problem): the part inside the page, or why there is none."""
    parts = (b.x0, b.y0, b.x1, b.y1)
    odd = F.lit(False)
    for p in parts:
        odd = odd | p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    clipped = box(F.greatest(F.lit(0.0), b.x0), F.greatest(F.lit(0.0), b.y0), F.least(width, b.x1), F.least(height, b.y1))
    problem = F.when(odd, "not_finite").when((b.x1 <= b.x0) | (b.y1 <= b.y0), "not_positive").when((clipped.x1 <= clipped.x0) | (clipped.y1 <= clipped.y0), "not_visible")
    return F.struct(F.when(problem.isNull(), clipped).alias("box"), problem.alias("problem"))


def signed_area(polygon: Column) -> Column:
    """Shoelace sum over the closed polygon, halved."""
    n = F.size(polygon)
    after = F.concat(F.slice(polygon, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(polygon, F.lit(1), F.lit(1)))
    terms = F.zip_with(polygon, after, lambda p, q: p.x * q.y - q.x * p.y)
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def polygon_box(polygon: Column) -> Column:
    xs, ys = F.transform(polygon, lambda p: p.x), F.transform(polygon, lambda p: p.y)
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def clip_polygon_points(polygon: Column, width: Column, height: Column) -> Column:
    """Points moved to the page; null unless three or more with an area remain."""
    zero = F.lit(0.0)
    moved = F.transform(polygon, lambda p: F.struct(F.least(F.greatest(p.x, zero), width).alias("x"), F.least(F.greatest(p.y, zero), height).alias("y")))
    return F.when((F.size(polygon) >= 3) & (F.abs(signed_area(moved)) > 0), moved)


def coverage(total_area: Column, width: Column, height: Column) -> Column:
    """Summed areas (overlaps count twice) of the page's, at most 1."""
    return F.when((width * height) <= 0, 0.0).otherwise(F.least(F.lit(1.0), total_area / (width * height)))


def multiply(a: Column, b: Column) -> Column:
    """Product of two mappings: b first, then a."""
    cell = lambda i, j: sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j])
    return F.array(*(cell(i, j) for i in range(3) for j in range(3)))


def apply_mapping(m: Column, x: Column, y: Column) -> Column:
    """The mapped point (x, y); null where it lies at infinity."""
    w = m[6] * x + m[7] * y + m[8]
    return F.when(F.abs(w) > 1e-12, F.struct(((m[0] * x + m[1] * y + m[2]) / w).alias("x"), ((m[3] * x + m[4] * y + m[5]) / w).alias("y")))


def map_box(m: Column, b: Column) -> Column:
    """The box around the four mapped corners."""
    corners = F.array(*(apply_mapping(m, x, y) for x, y in ((b.x0, b.y0), (b.x1, b.y0), (b.x1, b.y1), (b.x0, b.y1))))
    return polygon_box(corners)


def map_polygon(m: Column, polygon: Column) -> Column:
    return F.transform(polygon, lambda p: apply_mapping(m, p.x, p.y))


def scale_mapping(sx: float, sy: float) -> list[float]:
    return [sx, 0.0, 0.0, 0.0, sy, 0.0, 0.0, 0.0, 1.0]


def shift_mapping(dx: float, dy: float) -> list[float]:
    """From crop coordinates to the page's."""
    return [1.0, 0.0, dx, 0.0, 1.0, dy, 0.0, 0.0, 1.0]


def rotation_mapping(width: float, height: float, degrees: float) -> tuple[list[float], float, float]:
    """From the pixels of a picture rotated about its centre (and grown to fit) to the picture's; with the new size."""
    t = math.radians(degrees)
    c, s = math.cos(t), math.sin(t)
    w, h = abs(width * c) + abs(height * s), abs(width * s) + abs(height * c)
    m = [c, -s, width / 2 - c * w / 2 + s * h / 2, s, c, height / 2 - s * w / 2 - c * h / 2, 0.0, 0.0, 1.0]
    return m, w, h


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def homography(source: pd.Series, target: pd.Series) -> pd.Series:
    """The mapping that takes four source points to four target points; null where there is none."""

    def solve(src, dst):
        rows, right = [], []
        for p, q in zip(src, dst):
            x, y, u, v = p["x"], p["y"], q["x"], q["y"]
            rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
            right += [u, v]
        try:
            return [*np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist(), 1.0]
        except (np.linalg.LinAlgError, ValueError):
            return None

    return pd.Series([solve(s, t) if s is not None and t is not None and len(s) == len(t) == 4 else None for s, t in zip(source, target)])


def render_size(points: Column, dpi: Column) -> Column:
    """Pixels of a length in points, rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(points * dpi / 72).cast("int"))


def pixel_box(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels around the box, inside the picture."""
    return F.struct(
        F.greatest(F.lit(0), F.floor(b.x0)).cast("int").alias("x0"),
        F.greatest(F.lit(0), F.floor(b.y0)).cast("int").alias("y0"),
        F.least(width, F.ceil(b.x1)).cast("int").alias("x1"),
        F.least(height, F.ceil(b.y1)).cast("int").alias("y1"),
    )
