"""The pattern layer: e-mail addresses, phones, social security numbers, cards and reference codes.

All families run in one projection over the text; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contract import CONFIDENCE
from ..functions.matching import all_matches, greedy
from ..functions.scalars import digits, luhn_ok, span_struct

# The patterns, with Unicode digits, white space and word boundaries. The groups of a reference code
# are possessive, as Java's matcher would need stack for each to come back to; each ends at a word boundary instead.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)\+?\d[\d\s().\-]{7,}\d"
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
ACCOUNT = r"(?U)\b\d[\d \-]{11,21}\d\b"
REFERENCE = r"(?U)\b[A-Z0-9]++(?:-[A-Z0-9]++\b)++"

CANDIDATE = "struct<start:int,end:int,text:string,type:string,reason:string,normalized_value:string,priority:int>"


def _as(matches: Column, pii_type: str, reason: str, priority: int, normalized=None) -> Column:
    return F.transform(
        matches,
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.lit(pii_type).alias("type"), F.lit(reason).alias("reason"), (normalized(m["text"]) if normalized else F.lit(None).cast("string")).alias("normalized_value"), F.lit(priority).alias("priority")),
    )


def _holds(text: Column | str, sign: str) -> Column:
    return F.contains(F.col(text) if isinstance(text, str) else text, F.lit(sign))


def emails(text: Column | str) -> Column:
    return _as(all_matches(text, EMAIL, _holds(text, "@")), "EMAIL", "email-address pattern", 0, F.lower)


def phones(text: Column | str) -> Column:
    found = F.filter(all_matches(text, PHONE), lambda m: F.length(digits(m["text"])).between(9, 15))
    return _as(found, "PHONE", "phone-number pattern", 1, digits)


def ssns(text: Column | str) -> Column:
    return _as(all_matches(text, SSN, _holds(text, "-")), "ID_NUMBER", "US SSN pattern (NNN-NN-NNNN)", 2)


def accounts(text: Column | str) -> Column:
    found = F.filter(all_matches(text, ACCOUNT), lambda m: luhn_ok(digits(m["text"])))
    return _as(found, "ID_NUMBER", "Luhn-valid account/card number", 2, digits)


def references(text: Column | str) -> Column:
    found = F.filter(all_matches(text, REFERENCE, _holds(text, "-")), lambda m: m["text"].rlike("[A-Z]") & m["text"].rlike("[0-9]"))
    return _as(found, "ID_NUMBER", "alphanumeric reference/ID code", 3)


def pattern_candidates(text: Column | str) -> Column:
    """The candidates of all families, before overlaps are resolved."""
    return F.concat(emails(text), phones(text), ssns(text), accounts(text), references(text))


def resolved(candidates: Column) -> Column:
    """Lower priority numbers win overlaps, then longer candidates, then earlier ones."""
    return greedy(candidates, [lambda c: c["priority"], lambda c: c["start"] - c["end"], lambda c: c["start"]], CANDIDATE)


def pattern_spans(text: Column | str) -> Column:
    """The layer's spans in order of start: array of candidates."""
    return F.when(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike("[@0-9]"), resolved(pattern_candidates(text))).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def pattern_rows(text: Column | str) -> Column:
    """The layer's candidates as an array of ``contract.SPAN`` structs."""
    return F.transform(pattern_spans(text), lambda c, k: span_struct(k.cast("long"), "regex", c["start"], c["end"], c["text"], c["type"], F.lit(CONFIDENCE["regex"]), c["reason"], c["normalized_value"]))


def detect_patterns(documents: DataFrame) -> DataFrame:
    """Candidates of the pattern layer for a table of documents (doc_id, text)."""
    return documents.select("doc_id", F.explode(pattern_rows("text")).alias("c")).select("doc_id", "c.*")
