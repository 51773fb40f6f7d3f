"""The vocabularies of statuses, flags, reasons and types that rows carry as strings."""

from __future__ import annotations

#: Certainty of a text; distinct from the status of a job.
VERIFICATION_STATUSES = ("accepted", "verified", "uncertain", "human_review_required", "failed")
PROCESSING_STATUSES = ("pending", "processing", "completed", "completed_with_warnings", "failed")
JOB_STATUSES = ("queued", "running", "completed", "completed_with_warnings", "failed")
PAGE_TYPES = ("native_text", "scanned", "image", "mixed", "unknown")
TEXT_TYPES = ("printed", "handwritten", "mixed", "unknown")
COORDINATE_SPACES = ("source_pixel", "rendered_pixel", "pdf_point")
EXTRACTION_METHODS = ("native_pdf_text", "ocr", "handwriting_recognition", "layout", "table_extraction", "manual_review")
BLOCK_TYPES = (
    "title", "paragraph", "text_line_group", "printed_text", "handwriting", "table", "form", "formula", "image", "figure", "caption", "header",
    "footer", "page_number", "sidebar", "list", "multi_column", "tiny_text", "unknown",
)
WARNING_SEVERITIES = ("info", "warning", "error")
REVIEW_FLAGS = (
    "low_confidence", "disagreement", "tiny_text", "missing_backend", "native_text_unreliable", "invalid_geometry", "language_uncertain",
    "confidence_scale_mismatch", "backend_failure", "capability_unavailable", "table_structure_uncertain", "independent_evidence_insufficient",
    "manual_review",
)
VERIFICATION_REASONS = (
    "low_primary_confidence", "backend_disagreement", "normalized_disagreement", "digit_disagreement", "punctuation_difference",
    "whitespace_difference", "tiny_text", "empty_text", "short_text", "suspicious_characters", "language_script_mismatch", "expected_format_mismatch",
    "low_image_quality", "confidence_scale_mismatch", "insufficient_evidence", "insufficient_independent_evidence", "retry_exhausted",
    "consensus_across_variants", "consensus_across_backends", "stable_across_variants", "independent_backend_consensus", "correlated_evidence_only",
    "backend_failure", "storage_failure",
)

#: Statuses that always need a review.
REVIEW_STATUSES = ("uncertain", "human_review_required", "failed")
#: Flags that a verified text with independent consensus may carry.
RETRY_FLAGS = ("low_confidence", "tiny_text")
BLOCKING_FLAGS = tuple(f for f in REVIEW_FLAGS if f not in RETRY_FLAGS)
#: Reasons that always need a review.
BLOCKING_REASONS = (
    "backend_disagreement", "normalized_disagreement", "digit_disagreement", "punctuation_difference", "confidence_scale_mismatch", "empty_text",
    "short_text", "suspicious_characters", "language_script_mismatch", "expected_format_mismatch", "low_image_quality", "retry_exhausted",
    "backend_failure", "storage_failure",
)
#: Reasons that make a single candidate unusable.
FATAL_REASONS = (
    "empty_text", "short_text", "suspicious_characters", "language_script_mismatch", "expected_format_mismatch",
)
#: Lowest certainty first, for roll-ups.
STATUS_RANK = {"verified": 1, "accepted": 2, "uncertain": 3, "human_review_required": 4, "failed": 5}
