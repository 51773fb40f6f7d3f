"""Decisions around pixels that need none: quality flags, escalation of tiny text, retry plans, crops, stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the quality flags.
LOW_CONTRAST, LOW_SHARPNESS, SKEW_DEGREES, PERSPECTIVE, BACKGROUND, TEXT_PIXELS, COMPRESSION = 10.0, 3.0, 1.0, 0.20, 0.12, 12.0, 0.70
DEFAULT_DPI, HIGH_DPI, TINY_DPI = 300, 450, 600
SOURCE = "source-render"


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in pairs)))


def quality_flags() -> Column:
    """Flags of a page by its measured columns, in order; an unknown measure raises none."""
    c = F.col
    return _codes(
        (c("contrast") < LOW_CONTRAST, "low_contrast"),
        (c("sharpness") < LOW_SHARPNESS, "low_sharpness"),
        (F.abs("skew") >= SKEW_DEGREES, "skew_detected"),
        (c("perspective") >= PERSPECTIVE, "perspective_suspected"),
        (c("background_variation") >= BACKGROUND, "uneven_background"),
        (c("text_scale") < TEXT_PIXELS, "tiny_text_suspected"),
        (c("compression") >= COMPRESSION, "compression_artifacts_suspected"),
    )


def tiny_text(line_height: Column, box_height: Column, first_pass_failed: Column, dense: Column, dpi: Column, scales: tuple[int, ...] = (2, 3, 4), max_scale: int = 4, pixels: float = TEXT_PIXELS) -> Column:
    """Struct (is_tiny, reasons, recommended_dpi, region_scales, requires_verification) of a region."""
    usable = sorted({s for s in scales if 2 <= s <= max_scale})
    if not usable or pixels <= 0:
        raise ValueError("tiny text needs a positive threshold and a scale from 2 on")
    reasons = _codes((line_height < pixels, "estimated_line_height_below_threshold"), (box_height < pixels, "detector_box_below_threshold"), (first_pass_failed & dense, "dense_region_first_pass_failed"))
    tiny = F.size(reasons) > 0
    return F.struct(
        tiny.alias("is_tiny"),
        reasons.alias("reasons"),
        F.when(tiny & (dpi < TINY_DPI), TINY_DPI).otherwise(dpi).cast("int").alias("recommended_dpi"),
        F.when(tiny, F.array(*map(F.lit, usable))).otherwise(F.array().cast("array<int>")).alias("region_scales"),
        tiny.alias("requires_verification"),
    )


@dataclass(frozen=True)
class Attempt:
    number: int
    stage: str
    backend: int = 0
    variant: str = SOURCE
    dpi: int | None = None
    scale: int = 1


def retry_plan(tiny: bool, backends: int, max_attempts: int = 6, variants: tuple[str, ...] = ("grayscale", "contrast"), scales: tuple[int, ...] = (2, 3, 4), high_dpi: int = HIGH_DPI, tiny_dpi: int = TINY_DPI) -> list[Attempt]:
    """Bounded, ordered plan: first pass, variants, resolution, one scale, other backends, other scales."""
    if max_attempts < 1 or not all(variants) or any(s < 2 for s in scales) or not 0 < high_dpi <= tiny_dpi:
        raise ValueError("invalid retry configuration")
    if backends < 1:
        return []
    scaled = [{"stage": "alternate_scale", "variant": f"region-scale-{s}", "scale": s} for s in scales]
    steps = [{"stage": "first_pass"}]
    steps += [{"stage": "alternate_preprocessing", "variant": v} for v in variants]
    steps += [{"stage": "higher_resolution", "dpi": tiny_dpi if tiny else high_dpi}, *scaled[:1]]
    steps += [{"stage": "alternate_backend", "backend": b} for b in range(1, backends)]
    steps += scaled[1:]
    return [Attempt(k, **s) for k, s in enumerate(steps[:max_attempts], 1)]


def retry_variants(tiny: Column, max_retries: int, scales: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Preprocessing variants of a region in order: the render as it is, then at most ``max_retries`` others."""
    names = lambda *v: F.array(*map(F.lit, v[: 1 + max(0, max_retries)]))
    return F.when(tiny, names(SOURCE, *(f"region-scale-{s}" for s in scales), "grayscale", "contrast")).otherwise(names(SOURCE, "grayscale", "contrast"))


def crop_box(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels of a region: corners inside the picture, one pixel at least each way."""
    low = lambda v, most: F.greatest(F.lit(0), F.least(most - 1, v.cast("int")))
    high = lambda v, least, most: F.greatest(least + 1, F.least(most, (v + 0.999).cast("int")))
    left, top = low(b.x0, width), low(b.y0, height)
    return F.struct(left.alias("x0"), top.alias("y0"), high(b.x1, left, width).alias("x1"), high(b.y1, top, height).alias("y1"))


def render_dimensions(width: Column, height: Column, dpi: Column, max_pixels: int) -> Column:
    """Struct (width, height, problem) of a page's render; a render over the limit is a problem, not a smaller picture."""
    side = lambda v: F.greatest(F.lit(1), F.bround(v * dpi / 72).cast("long"))
    problem = F.when((width <= 0) | (height <= 0) | (dpi <= 0), "not_positive").when(side(width) * side(height) > max_pixels, "too_many_pixels")
    return F.struct(side(width).alias("width"), side(height).alias("height"), problem.alias("problem"))


def stage_of(dpi: Column, scale: Column, retry_stage: Column | None = None) -> Column:
    """Tiny-text stage of an attempt: by the stage it was made in where that is known, else by dpi and scale."""
    by_dpi = F.when(dpi >= TINY_DPI, F.when(scale > 1, "crop_upscaled").otherwise("high_dpi")).otherwise("first_pass")
    if retry_stage is None:
        return by_dpi
    known = F.when(retry_stage == "first_pass", "first_pass").when(retry_stage == "higher_resolution", "high_dpi").when(retry_stage == "alternate_scale", "crop_upscaled")
    return F.coalesce(known, by_dpi)


def merge_mixed(native: DataFrame, recognized: DataFrame, keys: list[str]) -> DataFrame:
    """Native blocks, then the recognized ones of the page after them; wants ``block_order`` on both sides."""
    offset = native.groupBy(*keys).agg((F.max("block_order") + 1).alias("_offset"))
    after = recognized.join(offset, keys, "left").withColumn("block_order", F.col("block_order") + F.coalesce("_offset", F.lit(0))).drop("_offset")
    return native.unionByName(after, allowMissingColumns=True)


#: Names of fields that never leave in logs.
SENSITIVE = ("raw_text", "normalized_text", "text", "document_text", "ocr_text", "sensitive_content")


def redact(rows: DataFrame, columns: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """rows with the texts of sensitive columns replaced."""
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.lit("[REDACTED]")) for c in columns if c in rows.columns})
