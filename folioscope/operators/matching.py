"""Matching of predicted lines to reference lines, and of boxes to regions.

Equal ids meet in an equi-join.  Best-overlap assignment takes lines in order
and removes what is taken, so it runs a page at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .groups import doubles, sequential


def page_pairs(reference: DataFrame, prediction: DataFrame, keys: list[str]) -> DataFrame:
    """Reference pages with their prediction where there is one."""
    return reference.join(prediction, keys, "left")


def best_region(boxes: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, box_id, region_id): the region of the page with the largest intersection; the first of ties, null for none.

    Both sides of a page meet by its keys; only intersecting pairs are kept.
    """
    pairs = boxes.join(regions, keys).withColumn("_shared", g.intersection(F.col("box"), F.col("region"))).where("_shared > 0")
    best = pairs.groupBy(*keys, "box_id").agg(F.max_by("region_id", F.struct("_shared", (-F.col("region_idx")).alias("early"))).alias("region_id"))
    return boxes.select(*keys, "box_id").join(best, [*keys, "box_id"], "left")


def iou_pairs(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, left_id, right_id, iou) of the boxes of a page that overlap enough."""
    pairs = left.join(right, keys).withColumn("iou", g.iou(F.col("left_box"), F.col("right_box")))
    return pairs.where(F.col("iou") >= threshold).select(*keys, "left_id", "right_id", "iou")


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if union > 0 else 0.0


def _sides(reference: DataFrame, prediction: DataFrame, key: str, ref_order: str) -> DataFrame:
    """Both sides of every page as rows of one table, each in its own order."""
    side = lambda df, k, order: df.select(F.col(key).cast("string").alias(key), F.lit(k).alias("_side"), F.col(order).cast("long").alias("_order"), F.col("id").cast("string").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    return side(reference, 0, ref_order).unionByName(side(prediction, 1, "idx"))


def _parted(page: list[dict]) -> tuple[list[dict], list[dict], list[tuple], list[tuple]]:
    ref, pred = [r for r in page if not r["_side"]], [r for r in page if r["_side"]]
    boxes = lambda rows: [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows]
    return ref, pred, boxes(ref), boxes(pred)


def match_lines(reference: DataFrame, prediction: DataFrame, key: str = "page", threshold: float = 0.5) -> DataFrame:
    """(key, reference_id, prediction_id): one-to-one, reference lines in reading order.

    A prediction with the same id is taken without looking at boxes; else the
    free one with the largest overlap, if that reaches the threshold.  Wants
    key, id, reading_order (reference), idx (prediction), x0, y0, x1, y1.
    """

    def assign(page: list[dict]) -> list[tuple]:
        ref, pred, wanted, boxes = _parted(page)
        by_id: dict[str, int] = {}
        for k, p in enumerate(pred):
            by_id.setdefault(p["id"], k)
        free = dict.fromkeys(range(len(pred)))
        out = []
        for r, b in zip(ref, wanted):
            k = by_id.get(r["id"])
            if k is None:
                k = max(free, key=lambda j: _iou(b, boxes[j]), default=None)
                k = None if k is None or _iou(b, boxes[k]) < threshold else k
            if k in free:
                del free[k]
                out.append((r[key], r["id"], pred[k]["id"]))
            else:
                out.append((r[key], r["id"], None))
        return out

    def assign_all(rows: pa.Table, at: np.ndarray) -> pa.Table:
        groups, size = at.shape
        each = np.arange(groups)
        x0, y0, x1, y1 = (doubles(rows, c)[at] for c in ("x0", "y0", "x1", "y1"))
        ids = pc.fill_null(rows.column("id").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)[at]
        predicted = rows.column("_side").to_numpy()[at] == 1
        free, found = predicted.copy(), np.full(at.shape, -1)
        for i in range(size):
            b = slice(i, i + 1)
            shared = np.maximum(0.0, np.minimum(x1[:, b], x1) - np.maximum(x0[:, b], x0)) * np.maximum(0.0, np.minimum(y1[:, b], y1) - np.maximum(y0[:, b], y0))
            union = (x1[:, b] - x0[:, b]) * (y1[:, b] - y0[:, b]) + (x1 - x0) * (y1 - y0) - shared
            iou = np.where(free, np.divide(shared, union, out=np.zeros(at.shape), where=union > 0), -np.inf)
            same = predicted & (ids == ids[:, b])
            named, k = same.any(1), iou.argmax(1)
            k = np.where(named, same.argmax(1), k)
            taken = ~predicted[:, i] & free[each, k] & (named | (iou[each, k] >= threshold))
            found[taken, i] = at[taken, k[taken]]
            free[each[taken], k[taken]] = False
        wanted = ~predicted
        reference_at, k = at[wanted], found[wanted]
        ours = rows.take(reference_at)
        return pa.table({key: ours.column(key), "reference_id": ours.column("id"), "prediction_id": rows.column("id").take(pa.array(k, mask=k < 0))})

    # Lines of one place in the order are told apart by id and box, so that the result does not hang on the shuffle.
    order = ["_side", "_order", "id", "x0", "y0", "x1", "y1"]
    return sequential(_sides(reference, prediction, key, "reading_order"), [key], order, assign, f"{key} string, reference_id string, prediction_id string", assign_all, ("x0", "y0", "x1", "y1"))


def detection(reference: DataFrame, prediction: DataFrame, key: str = "page", threshold: float = 0.5) -> DataFrame:
    """(key, n_reference, n_predicted, n_matched, precision, recall): greedy, in the predictions' order."""

    def count(page: list[dict]) -> list[tuple]:
        ref, pred, boxes, predicted = _parted(page)
        free, hits = dict.fromkeys(range(len(ref))), 0
        for b in predicted:
            k = max(free, key=lambda j: _iou(b, boxes[j]), default=None)
            if k is not None and _iou(b, boxes[k]) >= threshold:
                del free[k]
                hits += 1
        precision = hits / len(pred) if pred else 0.0
        return [(page[0][key], len(ref), len(pred), hits, precision, hits / len(ref) if ref else 0.0)]

    return sequential(_sides(reference, prediction, key, "idx"), [key], ["_side", "_order"], count, f"{key} string, n_reference long, n_predicted long, n_matched long, precision double, recall double")


def same_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has: (key, side).  None if the sets are equal."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def cell_accuracy(reference: DataFrame, prediction: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reference_cells, matches): cells equal in address and text; of repeated predictions the last counts."""
    address = [*keys, "row", "column"]
    text = lambda: F.coalesce("normalized_text", "raw_text")
    last = prediction.groupBy(*address).agg(F.max_by(text(), "idx").alias("_predicted"))
    ref = reference.select(*address, text().alias("_text"))
    return ref.join(last, address, "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("reference_cells"), F.count_if(F.col("_text") == F.col("_predicted")).alias("matches"))
