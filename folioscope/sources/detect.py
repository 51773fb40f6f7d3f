"""Content types from bytes or text, without trust in names."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Signatures in hexadecimal, content types, file suffixes.
SIGNATURES = {"255044462D": "application/pdf", "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "49492A00": "image/tiff", "4D4D002A": "image/tiff"}
OLE_SIGNATURE = "D0CF11E0A1B11AE1"
OFFICE = "application/vnd.openxmlformats-officedocument"
CONTAINERS = {"word/document.xml": f"{OFFICE}.wordprocessingml.document", "xl/workbook.xml": f"{OFFICE}.spreadsheetml.sheet", "ppt/presentation.xml": f"{OFFICE}.presentationml.presentation"}
SUFFIXES = {"txt": "text/plain", "log": "text/plain", "csv": "text/csv", "json": "application/json", "html": "text/html", "htm": "text/html"}
HTML_TAG = r"(?i)<\s*(?:!doctype\s+html|html|body|head|title|meta|p|div|span|table|script|main|article)\b"
TEXT_TYPES = ("text/plain", "text/csv", "text/html", "application/json")
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, byte_size, sha256) of the files below a path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content", F.length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha256"))


def split_lines(text: Column) -> Column:
    """Lines of a text as Python's splitlines gives them: no empty one after a final line end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_html(text: Column) -> Column:
    return F.substring(text, 1, 4096).rlike(HTML_TAG)


def is_csv(text: Column) -> Column:
    """Two rows or more, and one delimiter as often in each of the first 32 rows that aren't blank."""
    lines = split_lines(text)
    rows = F.filter(F.slice(lines, 1, 32), lambda r: F.trim(F.translate(r, "\t\x0b\x0c", "   ")) != "")
    steady = F.lit(False)
    for d in (",", ";", "\t", "|"):
        counts = F.transform(rows, _counter(d))
        steady = steady | ((F.size(rows) >= 2) & (counts[0] > 0) & (F.size(F.array_distinct(counts)) == 1))
    return (F.size(lines) >= 2) & F.coalesce(steady, F.lit(False))


def _counter(delimiter: str):
    return lambda row: F.length(row) - F.length(F.translate(row, delimiter, ""))


def text_type(text: Column) -> Column:
    """Type of an undeclared text; null where nothing in it tells (one line of plain text)."""
    body = F.regexp_replace(text, "^﻿", "")
    stripped = F.regexp_replace(body, r"(?U)^\s+", "")
    json = stripped.rlike(r"^[{\[]") & F.try_parse_json(body).isNotNull()
    return (
        F.when(F.instr(body, "\0") > 0, F.lit(None).cast("string"))
        .when(json, "application/json")
        .when(is_html(body), "text/html")
        .when(is_csv(body), "text/csv")
        .when(body.rlike(r"[\r\n]") & (F.length(stripped) > 0), "text/plain")
    )


def declared_type(text: Column, declared: Column) -> Column:
    """A declared text type, if the text bears it out; null if not."""
    d = F.lower(F.trim(declared))
    delimited = text.rlike(r"[,;\t|]") & (F.length(text) > 0)
    return F.when(d == "application/json", F.when(F.try_parse_json(text).isNotNull(), d)).when(d == "text/html", F.when(is_html(text), d)).when(d == "text/csv", F.when(delimited, d)).when(d == "text/plain", d)


@F.pandas_udf(T.StringType())
def office_type(content: pd.Series) -> pd.Series:
    """Type of an office container by its members; null if it is none."""

    def one(data: bytes | None) -> str | None:
        try:
            names = {n.replace("\\", "/").lower() for n in zipfile.ZipFile(io.BytesIO(data or b"")).namelist()}
        except zipfile.BadZipFile:
            return None
        return next((t for member, t in CONTAINERS.items() if member in names), None)

    return content.map(one)


def detect(df: DataFrame, content: str = "content", declared: str | None = None, path: str | None = None) -> DataFrame:
    """df with ``content_type`` and ``type_error`` (empty_source, malformed_office, unsupported).

    Signatures first, then containers, then text; a path's suffix decides only
    for text without a sign.
    """
    c = F.col(content)
    head = F.hex(F.substring(c, 1, 12))
    by_signature = F.lit(None).cast("string")
    for signature, kind in SIGNATURES.items():
        by_signature = F.when(head.startswith(signature), kind).otherwise(by_signature)
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    zipped, ole = head.startswith("504B0304"), head.startswith(OLE_SIGNATURE)
    text = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string"))
    kind = F.coalesce(by_signature, F.when(webp, "image/webp"))
    as_text = text_type(text)
    if declared is not None:
        as_text = F.coalesce(declared_type(text, F.col(declared)), F.when(F.col(declared).isNull() | ~F.lower(declared).isin(*TEXT_TYPES), as_text))
    if path is not None:
        by_suffix = F.lit(None).cast("string")
        for suffix, value in SUFFIXES.items():
            by_suffix = F.when(F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)) == suffix, value).otherwise(by_suffix)
        as_text = F.coalesce(as_text, F.when(text.isNotNull() & (F.instr(text, "\0") == 0), by_suffix))
    # Only zip files reach the Python step with their bytes.
    out = df.withColumn("_office", office_type(F.when(zipped, c)))
    kind = F.coalesce(kind, F.when(zipped, F.col("_office")), F.when(ole, "application/vnd.ms-excel"), F.when(~zipped & ~ole, as_text))
    out = out.withColumn("content_type", kind)
    error = F.when(F.length(c) == 0, "empty_source").when(F.col("content_type").isNull(), F.when(zipped, "malformed_office").otherwise("unsupported"))
    return out.withColumn("type_error", error).withColumn("content_type", F.when(F.col("type_error").isNull(), F.col("content_type"))).drop("_office")


def safe_name(name: Column) -> Column:
    """Whether a file name can be accepted: no path, no control characters, at most 255 characters."""
    return (F.length(name) > 0) & (F.length(name) <= 255) & ~name.rlike(r"[/\\:\x00-\x1f]") & ~name.isin(".", "..")


def accepted(df: DataFrame, max_bytes: int, allowed: tuple[str, ...], name: str, declared: str, size: str = "byte_size") -> DataFrame:
    """df with ``rejection``: null, or why an upload is refused (the declared type has to be the detected one)."""
    return df.withColumn(
        "rejection",
        F.when(F.col(size) == 0, "source_is_empty").when(F.col(size) > max_bytes, "too_large").when(~safe_name(F.col(name)), "unsafe_name").when(F.col("content_type").isNull() | (F.col("content_type") != F.col(declared)) | ~F.col("content_type").isin(*allowed), "unsupported_type"),
    )
