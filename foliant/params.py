"""Named defaults of the engine."""

from __future__ import annotations

from dataclasses import dataclass

# Default limits and parameters.
MAX_CHUNK_CHARACTERS = 2400
SMALL_SECTION_MAX_CHARACTERS = 4000
NEIGHBOUR_DISTANCE = 1
EMBEDDING_DIMENSIONS = 1024
EMBEDDING_BATCH = 16
DEFAULT_LIMIT = 5
MAX_LIMIT = 50
MIN_SCORE = 0.35
CANDIDATE_MULTIPLIER = 4
ROUTING_MAX_SOURCES = 3
ROUTING_MIN_TOKEN_LENGTH = 3
ROUTING_MIN_SCORE = 3
RRF_K = 60
PREVIEW_TTL_HOURS = 24
PREVIEW_SAMPLES = 3
PREVIEW_SAMPLE_CHARACTERS = 1000
PREVIEW_EXCERPT_CHARACTERS = 400
PREVIEW_MATCHES = 10

# Version strings that enter the stage fingerprints.
PARSER_VERSION = "native-parser-v1"
CHUNKER_VERSION = "paragraph-chunker-v2"
COMPOSER_VERSION = "embedding-input-v1"


@dataclass(frozen=True)
class Limits:
    """Contract limits of one document."""

    max_bytes: int = 10_485_760
    max_sections: int = 2000
    max_chunks: int = 10_000

    def __post_init__(self) -> None:
        for name in ("max_bytes", "max_sections", "max_chunks"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")


def check_limit(k: int, max_limit: int = MAX_LIMIT) -> int:
    """A result limit lies in 1..max_limit."""
    if not 1 <= k <= max_limit:
        raise ValueError(f"limit must be between 1 and {max_limit}")
    return k


def check_min_score(min_score: float) -> float:
    if not -1.0 <= min_score <= 1.0:
        raise ValueError("min_score must be between -1 and 1")
    return min_score
