"""The whole way of a document as one plan: lines and candidates, verification, roll-up, export.

Recognition is given from outside: ``recognize`` runs a recogniser (an adapter)
on the regions that its route names, and its rows are candidates like native
lines.  Every step is keyed by document, page and line (or cell), so the plan
shuffles by line once, by page and by document after that on aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import contracts
from ..functions import text as tx
from . import export, rollup, verify

LINE_KEYS = ["document_id", "page_number", "line_id"]
CELL_KEYS = [*LINE_KEYS, "cell_row", "cell_column"]


class Processed(NamedTuple):
    """Settled items, pages with their uncertainty, documents with their quality, and exported texts."""

    items: DataFrame
    pages: DataFrame
    documents: DataFrame
    texts: DataFrame


def native_candidates(lines: DataFrame) -> DataFrame:
    """Native lines (document_id, page_number, line_index, text) as candidates that are sure of themselves."""
    return lines.select(
        "document_id", "page_number", F.concat(F.lit("line-"), F.col("line_index")).alias("line_id"), F.col("line_index").alias("position"), F.lit(0).alias("attempt_idx"),
        F.col("text").alias("raw_text"), F.lit(1.0).alias("confidence"), F.lit("native_pdf_text").alias("method"), F.lit("native").alias("backend"), F.lit("native").alias("backend_family"),
        F.lit("unit").alias("confidence_scale"), tx.infer_language(F.col("text")).alias("language"), tx.infer_script(F.col("text")).alias("script"),
    )


def recognize(regions: DataFrame, backends: Mapping[str, contracts.Adapter], route: str = "route", key: str = "region_id") -> DataFrame:
    """The recognisers' rows for the regions of their routes; a route without one gives rows that say so.

    One plan branch for each route, none for each row: a region is read by its own recogniser only.
    """
    named = list(backends)
    lacking = regions.where(F.col(route).isNull() | ~F.col(route).isin(*named)) if named else regions
    out = contracts.run(lacking, contracts.Unavailable("none", key), key).withColumn("route", F.lit(None).cast("string"))
    for name, adapter in backends.items():
        out = out.unionByName(contracts.run(regions.where(F.col(route) == name), adapter, key).withColumn("route", F.lit(name)))
    return out


def settled(candidates: DataFrame, keys: list[str], policy: verify.Policy = verify.Policy(), normalization: tx.Normalization = tx.DEFAULT) -> DataFrame:
    """Verified and settled lines or cells (by their keys) with ``position``, ``disagreement`` and the columns that exports want."""
    # Texts are compared in the form that is also the first step of most policies: it is taken once.
    formed = candidates.withColumn("compared_text", tx.unicode_form(F.col("raw_text")))
    same = normalization.unicode_form == "NFC"
    text = F.coalesce(F.col("compared_text" if same else "raw_text"), F.lit(""))
    normalized = formed.withColumn("normalized_text", tx.normalize(text, replace(normalization, unicode_form=None) if same else normalization))
    # The share of later candidates that differ from the first, as ``verify.disagreement``, in the same aggregation as the position.
    per_text = normalized.groupBy(*keys, "normalized_text").agg(F.count(F.lit(1)).alias("_n"), F.min("attempt_idx").alias("_first"), F.min("position").alias("_at"))
    summed = per_text.groupBy(*keys).agg(F.min("_at").alias("position"), F.min_by("_n", F.struct("_first", "normalized_text")).alias("_same"), F.sum("_n").alias("_all"))
    several = F.when((F.col("_all") > 1) & F.lit(policy.max_attempts > 1), (F.col("_all") - F.col("_same")) / (F.col("_all") - 1))
    out = verify.verify(normalized, keys, policy=policy).join(summed.select(*keys, "position", several.alias("disagreement")), keys)
    need = F.col("status").isin("uncertain", "human_review_required", "failed")
    return rollup.settle(out.withColumns({"needs_review": need, "corrected_text": F.lit(None).cast("string")}))


def process(candidates: DataFrame, pages: DataFrame, cells: DataFrame | None = None, policy: verify.Policy = verify.Policy(), export_policy: str = "accepted_verified", normalization: tx.Normalization = tx.DEFAULT, hold: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> Processed:
    """From candidates of lines (and of table cells, keyed by line id, row and column) to exported texts.

    ``pages`` are (document_id, page_number).  ``hold`` keeps the settled items,
    which all else is made from (by default in memory and on disk; a job would
    write them as a table and read it again).  Edge cases: a page without
    candidates is exported empty, its document too; any uncertain cell makes its
    page uncertain, as any line does; rows of one line and attempt are ordered as they come.
    """
    none = {"cell_row": F.lit(None).cast("int"), "cell_column": F.lit(None).cast("int")}
    items = settled(candidates, LINE_KEYS, policy, normalization).withColumns(none | {"kind": F.lit("line")})
    if cells is not None:
        found = settled(cells, CELL_KEYS, policy, normalization).withColumn("kind", F.lit("cell"))
        items = items.unionByName(found.select(*items.columns))
    items = hold(items).withColumn("block_order", F.when(F.col("cell_row").isNull(), F.lit(0)).otherwise(F.lit(1)))
    empty = F.array().cast("array<string>")
    parents = pages.select("document_id", "page_number").distinct().withColumns({"status": F.lit("accepted"), "needs_review": F.lit(False), "flags": empty, "reason_codes": empty})
    rolled = rollup.roll_up(items, parents, ["document_id", "page_number"])
    quality = rollup.document_quality(items, ["document_id"])
    documents = pages.select("document_id").distinct().join(quality, "document_id", "left").withColumn("quality_status", F.coalesce("quality_status", F.lit("accepted")))
    texts = export.document_text(export.pages_text(items, pages, export_policy))
    return Processed(items, rolled, documents, texts)
