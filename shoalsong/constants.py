"""Published values and the parameter sets built from them."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: results only agree when these are exactly as published. ---

# Site type code -> health status, in tie-break order.
CATEGORIES = (
    ("H", "healthy"),
    ("D", "degraded"),
    ("R", "restored_early"),
    ("M", "restored_mid"),
)
UNKNOWN_STATUS = "unknown"
UNKNOWN_SITE = "unknown"
UNKNOWN_COUNTRY = "Unknown"
UNKNOWN_SITE_TYPE = "U"

# Similarity given to a category that has no comparable reference.
EMPTY_CATEGORY_SIMILARITY = 0.1

# Answer when the reference table is empty.
PLACEHOLDER_PROBABILITIES = (
    ("healthy", 0.65),
    ("degraded", 0.15),
    ("restored_early", 0.10),
    ("restored_mid", 0.10),
)
PLACEHOLDER_SITES = (
    ("aus_H1", 0.94, "Australia", "healthy"),
    ("idn_H1", 0.91, "Indonesia", "healthy"),
    ("aus_H2", 0.88, "Australia", "healthy"),
)

# The published reference sites: site_id, country, status.
REFERENCE_SITES = (
    ("aus_H1", "Australia", "healthy"),
    ("aus_H2", "Australia", "healthy"),
    ("idn_H1", "Indonesia", "healthy"),
    ("aus_D1", "Australia", "degraded"),
    ("phl_D1", "Philippines", "degraded"),
    ("mex_R1", "Mexico", "restored_early"),
    ("aus_R1", "Australia", "restored_early"),
    ("idn_M1", "Indonesia", "restored_mid"),
)
COUNTRY_NAMES = (
    ("aus", "Australia"),
    ("idn", "Indonesia"),
    ("phl", "Philippines"),
    ("mex", "Mexico"),
)

CAVEAT = (
    "Classification based on acoustic similarity to reference sites. "
    "Not a definitive health diagnosis. "
    "Complements but does not replace visual surveys."
)
SYNTHETIC_CAVEAT = " (Demo mode: using synthetic embeddings)"

MAX_FILE_BYTES = 50 * 1024 * 1024
DEFAULT_CONTENT_TYPE = "audio/wav"

FILE_TOO_LARGE = "FILE_TOO_LARGE"
AUDIO_TOO_SHORT = "AUDIO_TOO_SHORT"
AUDIO_TOO_LONG = "AUDIO_TOO_LONG"
INVALID_AUDIO_FORMAT = "INVALID_AUDIO_FORMAT"
PROCESSING_FAILED = "PROCESSING_FAILED"
MISSING_UPLOAD_ID = "MISSING_UPLOAD_ID"
UPLOAD_NOT_FOUND = "UPLOAD_NOT_FOUND"
ANALYSIS_NOT_FOUND = "ANALYSIS_NOT_FOUND"
ANALYZE_FAILED = "ANALYZE_FAILED"

EMBEDDING_WIDTH = 1280
FEATURE_BLOCK = 320
FEATURE_NOISE = 0.1
SPECTRUM_EPSILON = 1e-10
CENTROID_SCALE_HZ = 16000.0
STORED_DECIMALS = 6
TOP_SITES = 3
REFERENCE_POINTS = 10

GB_SECOND_RATE = 0.0000166667
FREE_GB_SECONDS = 400_000.0
REQUEST_RATE = 0.20 / 1_000_000
FREE_REQUESTS = 1_000_000

# --- End of fixed values. ---


@dataclass(frozen=True)
class SegmentSpec:
    """How a recording is validated, resampled and cut."""

    rate: int = 32000
    seconds: float = 5.0
    min_seconds: float = 5.0
    max_seconds: float = 600.0

    @property
    def samples(self) -> int:
        return int(round(self.rate * self.seconds))


CURRENT_SPEC = SegmentSpec()
# Window of the older training data set.
TRAINING_SPEC = SegmentSpec(rate=16000, seconds=1.88, min_seconds=1.88)
