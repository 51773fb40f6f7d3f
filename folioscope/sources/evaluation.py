"""Evaluation data: documents of ground truth or predictions as flat tables, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..operators.imaging import stage_of

_TEXT = "id: string, raw_text: string, normalized_text: string, bbox: array<double>, reading_order: int"
_STATE = "verification_status: string, confidence: double, sent_to_verification: boolean"
_CANDIDATES = "candidates: array<struct<backend: string, raw_text: string, normalized_text: string>>"
_STAGES = "tiny_text_stages: array<struct<stage: string, raw_text: string, normalized_text: string>>"
_LINE = f"struct<{_TEXT}, tiny_text: boolean, {_STATE}, {_CANDIDATES}, {_STAGES}>"
_CELL = f"struct<{_TEXT}, row: int, column: int, verification_status: string, confidence: double>"
_PAGE = f"struct<page_number: int, width: double, height: double, page_text: string, lines: array<{_LINE}>, table_cells: array<{_CELL}>>"
SCHEMA = f"schema_version string, dataset_version string, name string, documents array<struct<document_id: string, category: string, source_uri: string, pages: array<{_PAGE}>>>"


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents, pages, lines and cells of a JSON file of ground truth or predictions."""
    docs = spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")
    pages = docs.select("document_id", "category", F.explode("pages").alias("p"))
    keys = ["document_id", "category", F.col("p.page_number").alias("page_number")]

    def items(name: str) -> DataFrame:
        flat = pages.select(*keys, F.posexplode(f"p.{name}").alias("idx", "x")).select("document_id", "category", "page_number", "idx", "x.*")
        b = F.col("bbox")
        return flat.withColumn("bbox", box(b[0], b[1], b[2], b[3]))

    lines = items("lines")
    empty = {c: F.coalesce(c, F.expr(f"cast(array() as {t})")) for c, t in (("candidates", _CANDIDATES.split(": ", 1)[1]), ("tiny_text_stages", _STAGES.split(": ", 1)[1]))}
    lines = lines.withColumns(empty | {"sent_to_verification": F.coalesce("sent_to_verification", F.lit(False)), "tiny_text": F.coalesce("tiny_text", F.lit(False))})
    return {"documents": docs.drop("pages"), "pages": pages.select(*keys, "p.width", "p.height", "p.page_text"), "lines": lines, "cells": items("table_cells")}


def problems(tables: dict[str, DataFrame]) -> DataFrame:
    """(document_id, problem): repeated ids, page numbers with gaps, boxes outside their page."""
    docs, pages, lines = tables["documents"], tables["pages"], tables["lines"]
    named = lambda df, what: df.select("document_id", F.lit(what).alias("problem")).distinct()
    repeated = docs.groupBy("document_id").count().where("count > 1")
    gaps = pages.groupBy("document_id").agg(F.max("page_number").alias("m"), F.countDistinct("page_number").alias("n"), F.min("page_number").alias("a"), F.count(F.lit(1)).alias("all")).where("m <> n or a <> 1 or n <> all")
    twice = lines.groupBy("document_id", "page_number", "id").count().where("count > 1")
    sized = lines.join(pages.select("document_id", "page_number", "width", "height"), ["document_id", "page_number"])
    outside = sized.where("bbox.x0 < 0 or bbox.y0 < 0 or bbox.x1 > width or bbox.y1 > height or bbox.x0 > bbox.x1 or bbox.y0 > bbox.y1")
    return named(repeated, "repeated_document").unionByName(named(gaps, "page_numbers")).unionByName(named(twice, "repeated_line")).unionByName(named(outside, "box_outside_page"))


def predictions(pages: DataFrame, lines: DataFrame, cells: DataFrame) -> dict[str, DataFrame]:
    """pages, lines and cells of processed documents in the shape that ``evaluate`` compares.

    Wants lines with block_order, position, dpi, region_scale and attempts
    beside their text and state; a page's text is its lines in order.
    """
    keys = ["document_id", "page_number"]
    ordered = F.array_sort(F.collect_list(F.struct("block_order", "position", F.col("raw_text").alias("t"))))
    text = lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x.t), "\n").alias("page_text"))
    candidate = lambda a: F.struct(a.backend.alias("backend"), a.raw_text.alias("raw_text"), a.normalized_text.alias("normalized_text"))
    stage = lambda a: F.struct(stage_of(a.dpi, a.region_scale).alias("stage"), a.raw_text.alias("raw_text"), a.normalized_text.alias("normalized_text"))
    tiny = F.when(F.col("tiny_text"), F.transform("attempts", stage)).otherwise(F.expr("cast(array() as array<struct<stage: string, raw_text: string, normalized_text: string>>)"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("block_order", "position")) - 1
    out = lines.select(
        *keys, at.alias("idx"), F.col("line_id").alias("id"), F.col("position").alias("reading_order"), "raw_text", "normalized_text", "bbox", "tiny_text", F.col("status").alias("verification_status"),
        (F.size("attempts") > 1).alias("sent_to_verification"), F.transform("attempts", candidate).alias("candidates"), tiny.alias("tiny_text_stages"),
    )
    flat = cells.select(*keys, F.col("cell_id").alias("id"), "row", "column", "raw_text", "normalized_text", F.monotonically_increasing_id().alias("idx"))
    return {"pages": pages.select(*keys).join(text, keys, "left").select(*keys, F.coalesce("page_text", F.lit("")).alias("page_text")), "lines": out, "cells": flat}
