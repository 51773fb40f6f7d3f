"""Exports of documents: text, Markdown, JSON, training labels, manifests, inventories.

Everything is derived from flat lines and cells; a document's entries meet in
one aggregation by document and page, ordered inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import REVIEW_STATUSES, VERIFICATION_STATUSES
from .governance import text_of
from .rollup import eligible


def status_label(status: Column, needs_review: Column) -> Column:
    return F.when(needs_review, F.concat(status, F.lit(";review"))).otherwise(status)


def escape_markdown(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def export_text(policy: str) -> Column:
    """The text of an item: corrected, or else raw; with its status where all is exported."""
    text = text_of(F.col("corrected_text"), F.col("raw_text"))
    return F.concat(F.lit("["), status_label(F.col("status"), F.col("needs_review")), F.lit("] "), text) if policy == "all_with_status" else text


def _joined(entry: list[str], text: str, separator: str) -> Column:
    """Texts in the order of the entry's columns; entries without text are left out."""
    ordered = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*entry, F.col(text).alias("_t")))))
    return F.array_join(F.transform(ordered, lambda e: e["_t"]), separator)


def pages_text(items: DataFrame, pages: DataFrame, policy: str = "accepted_verified") -> DataFrame:
    """(document_id, page_number, text) of every page.

    ``items`` are lines (cell_row null) and cells, with block_order, position,
    cell_row, cell_column; a block that has cells prints only those, a row to a
    line.
    """
    tables = items.where("cell_row is not null").select("document_id", "page_number", "block_order").distinct().withColumn("_table", F.lit(True))
    keys = ["document_id", "page_number", "block_order"]
    kept = items.join(tables, keys, "left").where(F.col("_table").isNull() | F.col("cell_row").isNotNull())
    kept = kept.where(eligible(policy, F.col("status"), F.col("needs_review"), F.col("flags"), F.col("reason_codes"))).withColumn("_text", export_text(policy))
    at = F.when(F.col("cell_row").isNull(), F.col("position")).otherwise(F.col("cell_row")).alias("_at")
    entries = kept.groupBy(*keys, at).agg(_joined(["cell_column", "position"], "_text", " | ").alias("_entry"))
    text = entries.groupBy("document_id", "page_number").agg(_joined(["block_order", "_at"], "_entry", "\n").alias("text"))
    return pages.select("document_id", "page_number").distinct().join(text, ["document_id", "page_number"], "left").select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("text"))


def document_text(pages: DataFrame) -> DataFrame:
    """(document_id, text): pages parted by a form feed and a line break."""
    return pages.groupBy("document_id").agg(F.concat(_joined(["page_number"], "text", "\f\n"), F.lit("\n")).alias("text"))


def markdown(lines: DataFrame, documents: DataFrame, policy: str = "accepted_verified") -> DataFrame:
    """(document_id, markdown) with a heading for each document, page and block, and an item for each line.

    ``lines`` may hold cells, which become rows of a table.
    """
    ok = eligible(policy, F.col("status"), F.col("needs_review"), F.col("flags"), F.col("reason_codes"))
    text = escape_markdown(text_of(F.col("corrected_text"), F.col("raw_text")))
    if policy == "all_with_status":
        text = F.concat(F.lit("["), status_label(F.col("status"), F.col("needs_review")), F.lit("] "), text)
    line = F.concat(F.lit("- "), F.col("position"), F.lit(" ["), F.col("status"), F.lit("] "), text)
    cell = F.concat_ws(" | ", F.concat(F.lit("| "), F.col("cell_row")), F.col("cell_column").cast("string"), escape_markdown(F.col("raw_text")), escape_markdown(F.coalesce("normalized_text", F.lit(""))), F.col("status"), F.concat(F.col("needs_review").cast("string"), F.lit(" |")))
    is_cell = F.col("cell_row").isNotNull()
    entry = F.when(ok, F.when(is_cell, cell).otherwise(line))
    order = [F.coalesce("cell_row", "position").alias("_a"), F.coalesce("cell_column", F.lit(0)).alias("_b")]
    keys = ["document_id", "page_number", "block_order"]
    table_head = "| Row | Column | Raw Text | Normalized Text | Status | Review |\n| ---: | ---: | --- | --- | --- | --- |\n"
    blocks = lines.withColumn("_entry", entry).select(*keys, "block_id", "block_type", is_cell.alias("_cell"), "_entry", *order)
    blocks = blocks.groupBy(*keys).agg(F.min("block_id").alias("_id"), F.min("block_type").alias("_type"), F.bool_or("_cell").alias("_cell"), _joined(["_a", "_b"], "_entry", "\n").alias("_body"))
    body = F.concat(F.lit("### Block "), "_id", F.lit(" ("), "_type", F.lit(")\n\n"), F.when(F.col("_cell"), table_head).otherwise(""), "_body", F.when(F.col("_body") == "", "").otherwise("\n"))
    pages = blocks.withColumn("_body", body).groupBy("document_id", "page_number").agg(_joined(["block_order"], "_body", "\n").alias("_page"))
    pages = pages.withColumn("_page", F.concat(F.lit("## Page "), "page_number", F.lit("\n\n"), "_page"))
    all_pages = pages.groupBy("document_id").agg(_joined(["page_number"], "_page", "\n").alias("_pages"))
    head = F.concat(F.lit("# Document "), "document_id", F.lit("\n\n- Status: "), "document_status", F.lit("\n\n"), F.coalesce("_pages", F.lit("")))
    return documents.join(all_pages, "document_id", "left").select("document_id", F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit("\n")).alias("markdown"))


def manifest_counts(items: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """(keys, counts of pages, lines, cells, statuses and exported items), one partial aggregation."""
    is_line, ok = F.col("cell_row").isNull(), eligible(policy, F.col("status"), F.col("needs_review"), F.col("flags"), F.col("reason_codes"))
    return items.groupBy(*keys).agg(
        F.countDistinct("page_number").alias("pages"),
        F.count_if(is_line).alias("lines"),
        F.count_if(~is_line).alias("table_cells"),
        *(F.count_if(is_line & (F.col("status") == s)).alias(s) for s in VERIFICATION_STATUSES),
        F.count_if(is_line & F.col("status").isin(*REVIEW_STATUSES)).alias("review_required"),
        F.count_if(is_line & ok).alias("exported_lines"),
        F.count_if(~is_line & ok).alias("exported_table_cells"),
    )


def backend_inventory(items: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct identities of the models behind the items; order the result where it is shown."""
    return items.select(*(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in columns)).distinct()


def export_key(checksum: Column, policy: str, formats: list[str], revision: Column) -> Column:
    """Folder of an export: by content, policy, formats and the document's revision, so a correction gives a new one."""
    tail = F.substring(F.sha2(F.concat_ws("|", F.lit(",".join(sorted(formats))), revision.cast("string")), 256), 1, 8)
    return F.concat(F.lit("export-"), F.substring(checksum, 1, 16), F.lit(f"-{policy}-"), tail)


def line_labels(lines: DataFrame) -> DataFrame:
    """Training label records of rendered lines with an area, as one struct column ``label``."""
    area = (F.col("bbox.x1") > F.col("bbox.x0")) & (F.col("bbox.y1") > F.col("bbox.y0"))
    kept = lines.where((F.col("coordinate_space") == "rendered_pixel") & area)
    fields = ["document_id", "page_number", "line_id", "raw_text", "normalized_text", "corrected_text", "status", "needs_review", "confidence", "bbox", "language", "script"]
    names = F.when(F.count(F.lit(1)).over(_same_name()) > 1, F.concat(F.lit("page-"), "page_number", F.lit("-"), "line_id")).otherwise(F.col("line_id"))
    return kept.select("document_id", "page_number", "line_id", names.alias("crop_name"), F.struct(*(c for c in fields if c in lines.columns)).alias("label"))


def _same_name():
    from pyspark.sql import Window

    return Window.partitionBy("document_id", "line_id")


def write(df: DataFrame, path: str, form: str = "json", partition_by: tuple[str, ...] = ()) -> None:
    """Writes an export below ``path``; an existing one is never overwritten (Spark commits it whole or not at all)."""
    df.write.mode("errorifexists").partitionBy(*partition_by).format(form).save(path)


def document_json(documents: DataFrame, pages: DataFrame, blocks: DataFrame, lines: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(document_id, json): the whole tree of each document, whatever the export policy.

    Children are ordered: pages by number, blocks by block_order, lines by
    position, cells by row and column.  Each level is one aggregation by its
    parent; a page's content is gathered, a corpus never.
    """

    def under(parents: DataFrame, children: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
        entry = F.struct(*order, F.struct(*(c for c in sorted(children.columns) if c not in keys)).alias("_v"))
        listed = children.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_v"]).alias(name))
        out = parents.join(listed, keys, "left")
        return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))

    block_keys = ["document_id", "page_number", "block_order"]
    tree = under(blocks, lines, block_keys, ["position"], "lines")
    if cells is not None:
        tree = under(tree, cells, block_keys, ["row", "column"], "table_cells")
    tree = under(pages, tree, block_keys[:2], ["block_order"], "blocks")
    tree = under(documents, tree, ["document_id"], ["page_number"], "pages")
    return tree.select("document_id", F.to_json(F.struct(*sorted(tree.columns)), {"ignoreNullFields": "false"}).alias("json"))


def page_manifests(pages: DataFrame, lines: DataFrame, policy: str) -> DataFrame:
    """(document_id, page_number, manifest): each page with its eligible lines, in order, as JSON."""
    ok = eligible(policy, F.col("status"), F.col("needs_review"), F.col("flags"), F.col("reason_codes"))
    keys = ["document_id", "page_number"]
    entry = F.struct("block_order", "position", F.struct(*(c for c in sorted(lines.columns) if c not in keys)).alias("_v"))
    kept = lines.where(ok).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_v"]).alias("lines"))
    out = pages.join(kept, keys, "left")
    out = out.withColumn("lines", F.coalesce("lines", F.array().cast(out.schema["lines"].dataType)))
    return out.select(*keys, F.to_json(F.struct(*sorted(out.columns))).alias("manifest"))
