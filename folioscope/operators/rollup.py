"""Roll-up of certainty from lines and cells to blocks, pages and documents.

Derived state: a correction of a line refreshes its parents.  Every level is
one partial aggregation; statuses travel as ranks, flags and reasons as
distinct sets in order of first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import BLOCKING_FLAGS, BLOCKING_REASONS, RETRY_FLAGS, REVIEW_STATUSES, STATUS_RANK


def rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in STATUS_RANK.items():
        out = F.when(status == name, value).otherwise(out)
    return out


def status_of(r: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in STATUS_RANK.items():
        out = F.when(r == value, name).otherwise(out)
    return out


def _uncertain(status: Column, flags: Column, reasons: Column) -> Column:
    """Whether flags or reasons block a text that is otherwise accepted or verified."""
    verified = status == "verified"
    independent = verified & F.array_contains(reasons, "independent_backend_consensus")
    soft = F.arrays_overlap(flags, F.lit(list(RETRY_FLAGS))) | F.arrays_overlap(reasons, F.lit(["low_primary_confidence", "tiny_text"]))
    weak = F.arrays_overlap(reasons, F.lit(["insufficient_independent_evidence", "correlated_evidence_only", "insufficient_evidence"]))
    return F.arrays_overlap(flags, F.lit(list(BLOCKING_FLAGS))) | F.arrays_overlap(reasons, F.lit(list(BLOCKING_REASONS))) | (soft & ~independent) | (verified & weak)


def requires_review(status: Column, needs_review: Column, flags: Column, reasons: Column, tiny: Column | None = None) -> Column:
    """Whether the evidence has to stay out of clean exports."""
    independent = (status == "verified") & F.array_contains(reasons, "independent_backend_consensus")
    out = needs_review | status.isin(*REVIEW_STATUSES) | _uncertain(status, flags, reasons)
    return out if tiny is None else out | (tiny & ~independent)


def settle(items: DataFrame, tiny: str | None = "tiny_text") -> DataFrame:
    """Lines or cells with their own status made consistent: what requires review says so."""
    need = requires_review(F.col("status"), F.col("needs_review"), F.col("flags"), F.col("reason_codes"), F.col(tiny) if tiny else None)
    out = items.withColumn("needs_review", need)
    return out.withColumn("status", F.when(F.col("needs_review") & F.col("status").isin("accepted", "verified"), "human_review_required").otherwise(F.col("status")))


def roll_up(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Parents (keys, status, needs_review, flags, reason_codes) with their children's uncertainty.

    ``children`` have the parents' keys, an ordering column ``position`` and the
    same state columns (and ``tiny_text`` where they are lines).
    """
    tiny = F.col("tiny_text") if "tiny_text" in children.columns else F.lit(False)
    state = children.withColumn("_review", requires_review(F.coalesce("status", F.lit("accepted")), F.col("needs_review"), F.col("flags"), F.col("reason_codes"), tiny))
    child = state.groupBy(*keys).agg(F.max(rank(F.col("status"))).alias("_rank"), F.bool_or("_review").alias("_review"), _distinct_in_order(state, "flags").alias("_flags"), _distinct_in_order(state, "reason_codes").alias("_reasons"))
    own = parents.join(child, keys, "left")
    lowest, status = status_of(F.col("_rank")), F.col("status")
    merged = (
        F.when(lowest == "failed", "failed")
        .when(lowest.isin("human_review_required", "uncertain") & status.isin("accepted", "verified"), lowest)
        .when(lowest.isin("accepted", "verified") & status.isin("accepted", "verified"), lowest)
        .otherwise(status)
    )
    empty = F.array().cast("array<string>")
    need = F.col("needs_review") | F.coalesce("_review", F.lit(False)) | requires_review(status, F.col("needs_review"), F.col("flags"), F.col("reason_codes")) | merged.isin(*REVIEW_STATUSES)
    out = own.withColumns({"_merged": merged, "_need": need})
    return out.withColumns(
        {
            "flags": F.array_distinct(F.concat("flags", F.coalesce("_flags", empty))),
            "reason_codes": F.array_distinct(F.concat("reason_codes", F.coalesce("_reasons", empty))),
            "needs_review": F.col("_need"),
            "status": F.when(F.col("_need") & F.col("_merged").isin("accepted", "verified"), "human_review_required").otherwise(F.col("_merged")),
        }
    ).drop("_rank", "_review", "_flags", "_reasons", "_merged", "_need")


def _distinct_in_order(state: DataFrame, column: str) -> Column:
    """The codes of all children by where each first occurs.

    One slot per code of the vocabulary: the least position that has it, so the
    aggregate is bounded however many children there are.
    """
    from ..vocabulary import REVIEW_FLAGS, VERIFICATION_REASONS

    names = REVIEW_FLAGS if column == "flags" else VERIFICATION_REASONS
    where = [F.min(F.when(F.array_contains(column, n), F.struct(F.col("position"), F.array_position(column, n).alias("k")))) for n in names]
    slots = F.array(*(F.struct(w.alias("at"), F.lit(n).alias("code")) for w, n in zip(where, names)))
    return F.transform(F.array_sort(F.filter(slots, lambda s: s["at"].isNotNull())), lambda s: s["code"])


def lowest_status(items: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """(keys, status, n): the lowest certainty among the items."""
    return items.groupBy(*keys).agg(status_of(F.max(rank(F.col(status)))).alias("status"), F.count(F.lit(1)).alias("n"))


def document_quality(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, quality_status, confidence_mean, confidence_min, disagreement_rate, review_count, line_count) of each document.

    ``items`` are lines and cells (kind line or cell) and, as kind block, blocks
    without lines; ``disagreement`` is null where there was one candidate.
    """
    content = F.col("kind") != "block"
    verified = F.count_if((F.col("kind") == "line") & (F.col("status") == "verified"))
    lines = F.count_if(F.col("kind") == "line")
    review = F.count_if(F.col("needs_review"))
    return items.groupBy(*keys).agg(
        F.when(review > 0, "human_review_required").when((lines > 0) & (verified == lines), "verified").otherwise("accepted").alias("quality_status"),
        F.avg(F.when(content, F.col("confidence"))).alias("confidence_mean"),
        F.min(F.when(content, F.col("confidence"))).alias("confidence_min"),
        F.coalesce(F.avg(F.when(content, F.col("disagreement"))), F.lit(0.0)).alias("disagreement_rate"),
        review.alias("review_count"),
        lines.alias("line_count"),
    )


def eligible(policy: str, status: Column, needs_review: Column, flags: Column, reasons: Column) -> Column:
    """Whether an item is exported: all_with_status, strict_verified_only or accepted_verified."""
    if policy == "all_with_status":
        return F.lit(True)
    wanted = {"strict_verified_only": ["verified"], "accepted_verified": ["accepted", "verified"]}[policy]
    return ~needs_review & status.isin(*wanted) & ~_uncertain(status, flags, reasons)
