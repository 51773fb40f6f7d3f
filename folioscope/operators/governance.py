"""Human corrections, retention, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_corrections(items: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """items with the latest correction of each: corrected text, verified, flags cleared; the raw text stays.

    ``corrections`` are append-only rows (keys, revision, corrected_text, reviewer, created_at).
    """
    latest = corrections.groupBy(*keys).agg(F.max_by(F.struct("corrected_text", "reviewer"), F.struct("created_at", "revision")).alias("_c"), F.count(F.lit(1)).alias("_n"))
    out = items.join(latest, keys, "left")
    done = F.col("_c").isNotNull()
    empty = F.array().cast("array<string>")
    return out.withColumns(
        {
            "corrected_text": F.col("_c.corrected_text"),
            "reviewer": F.col("_c.reviewer"),
            "revision": F.coalesce("_n", F.lit(0)),
            "status": F.when(done, "verified").otherwise(F.col("status")),
            "needs_review": ~done & F.col("needs_review"),
            "flags": F.when(done, empty).otherwise(F.col("flags")),
            "reason_codes": F.when(done, empty).otherwise(F.col("reason_codes")),
        }
    ).drop("_c", "_n")


def text_of(corrected: Column, raw: Column) -> Column:
    """The corrected text, unless there is none or it is empty."""
    return F.coalesce(F.nullif(corrected, F.lit("")), raw)


def deadline(created_at: Column, days: Column) -> Column:
    """When retention ends; null without a limit."""
    return F.when(days.isNotNull(), created_at + F.make_dt_interval(days.cast("int")))


def expired(created_at: Column, days: Column, now: Column) -> Column:
    return F.coalesce(now >= deadline(created_at, days), F.lit(False))


def deletable(documents: DataFrame, jobs: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents without a queued or running job."""
    return documents.join(jobs.where(F.col("status").isin("queued", "running")).select(key), key, "left_anti")
