"""Engine settings as plan-time constants, their modes, and a hash that tells configurations apart."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from dataclasses import dataclass, field, replace

from .functions.text import DEFAULT, Normalization
from .operators.verify import Policy

#: Retries, and whether a page is rendered again at high resolution, by mode.
MODES = {"fast": (0, False), "balanced": (2, True), "accurate": (3, True)}


@dataclass(frozen=True)
class Settings:
    """Limits and policies; secrets and machine paths have no place here."""

    max_bytes: int = 50 * 1024 * 1024
    max_pages: int = 500
    max_render_pixels: int = 50_000_000
    max_crop_pixels: int = 12_000_000
    default_dpi: int = 300
    high_quality_dpi: int = 450
    tiny_text_dpi: int = 600
    region_scales: tuple[int, ...] = (2, 3, 4)
    max_retries: int = 2
    high_quality_retry: bool = True
    tiny_line_points: float = 7.0
    min_layout_confidence: float = 0.35
    normalization: Normalization = DEFAULT
    verification: Policy = field(default_factory=lambda: Policy(max_attempts=6, verified_threshold=0.92))

    def __post_init__(self) -> None:
        if min(self.max_bytes, self.max_pages, self.max_render_pixels, self.default_dpi) < 1 or self.max_retries < 0:
            raise ValueError("limits are positive")
        if not self.default_dpi <= self.high_quality_dpi <= self.tiny_text_dpi:
            raise ValueError("resolutions rise from default to tiny text")

    def for_mode(self, mode: str) -> Settings:
        """The settings of a processing mode, which sets retries and the high-quality retry only."""
        retries, again = MODES[mode]
        return replace(self, max_retries=retries, high_quality_retry=again)

    def payload(self) -> dict:
        return dataclasses.asdict(self)

    def hash(self) -> str:
        """SHA-256 of the canonical JSON of the payload."""
        text = json.dumps(self.payload(), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=dict)
        return hashlib.sha256(text.encode()).hexdigest()


def from_environment(prefix: str = "FOLIOSCOPE_") -> Settings:
    """Settings with plain values taken from the environment, such as FOLIOSCOPE_MAX_PAGES."""
    given = {}
    for f in dataclasses.fields(Settings):
        raw = os.environ.get(prefix + f.name.upper())
        if raw is None:
            continue
        kind = type(getattr(Settings(), f.name))
        if kind is bool:
            given[f.name] = raw.strip().lower() in ("1", "true", "yes")
        elif kind in (int, float):
            given[f.name] = kind(raw)
        elif kind is tuple:
            given[f.name] = tuple(int(x) for x in raw.split(","))
        else:
            raise ValueError(f"{f.name} cannot be set from the environment")
    return Settings(**given)


#: Error codes of rows and whether trying again can help.
ERRORS = {
    "configuration_error": False, "invalid_document": False, "unsupported_document": False, "empty_source": False, "malformed_office": False, "unsupported": False,
    "document_busy": True, "idempotency_conflict": False, "queue_full": True, "timeout": True, "backend_failure": True, "capability_unavailable": False, "storage_failure": True,
}
