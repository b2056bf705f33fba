"""The data contract: types, constants, schemas and errors shared by all operators.

Offsets are code-point indices, end-exclusive, and a span's text is that slice of its document.
"""

from __future__ import annotations

# Fixed values of the contract.
PII_TYPES = ("PERSON", "ORG", "EMAIL", "PHONE", "ADDRESS", "ID_NUMBER", "OTHER")
OUTPUT_MODES = ("REDACT", "ANONYMIZE")
SOURCES = ("regex", "dictionary", "ner", "llm", "manual")
STRUCTURAL_SOURCES = ("regex", "dictionary")
LAYERS = ("regex", "dictionary", "ner", "llm")
TIER_HIGH, TIER_LOW_CONFIDENCE, TIER_SOFT_REVIEW = 1, 2, 3
CONFIDENCE = {"regex": 0.99, "dictionary": 0.98, "ner": 0.85, "llm": 0.55, "manual": 1.0}
REDACT_MARKER = "[REDACTED]"
DEFAULT_ALLOWLIST = ("Coastline Mutual", "Supreme Court of New South Wales", "District Court of New South Wales", "Federal Court of Australia")
ALLOWLIST_REASON = "known non-sensitive entity on the dictionary allowlist"
MANUAL_REASON = "Marked as missed PII by the reviewer."

#: One candidate span of a detection layer; ``arrival`` keeps the order in which candidates came.
SPAN_FIELDS = "start int, end int, text string, type string, confidence double, source string, reason string, normalized_value string"
CANDIDATES = f"doc_id long, arrival long, id string, {SPAN_FIELDS}"
ALLOW_RANGES = "doc_id long, start int, end int, text string, reason string"
ACTIONS = "doc_id long, seq long, type string, target_id string, start int, end int, pii_type string"


def fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a flat DDL schema."""
    return [tuple(x.split()) for x in ddl.split(", ")]


class SpanError(Exception):
    """An error with the status, code and detail that callers see."""

    def __init__(self, status: int, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.status, self.code, self.detail = status, code, detail

    def envelope(self) -> dict[str, str]:
        """The uniform error body."""
        return {"error": self.code, "detail": self.detail}


def error_envelope(error: Exception) -> tuple[int, dict[str, str]]:
    """Status and body for any error: domain errors keep theirs, wrong values are 422, all else is 500."""
    if isinstance(error, SpanError):
        return error.status, error.envelope()
    if isinstance(error, (ValueError, TypeError, KeyError)):
        return 422, {"error": "validation_error", "detail": str(error)}
    return 500, {"error": "internal_error", "detail": type(error).__name__}
