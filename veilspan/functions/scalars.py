"""Scalar column functions: numbers and text of spans, keys of their identity, words for display."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contract import PII_TYPES, REDACT_MARKER


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def folded_point(c: str) -> str:
    """A code point's lower case of its upper case, where both are single code points, as patterns without case compare them."""
    if c == "\u0130":  # its lower case is two code points, of which simple mappings take the first
        return "i"
    upper = c.upper()
    upper = upper if len(upper) == 1 else c
    lower = upper.lower()
    return lower if len(lower) == 1 else upper


@lru_cache(maxsize=1)
def point_folds() -> dict[int, str]:
    """All code points that ``folded_point`` changes."""
    return {k: f for k in range(sys.maxunicode + 1) if not 0xD800 <= k <= 0xDFFF and (f := folded_point(chr(k))) != chr(k)}


def point_folded(text: Column | str) -> Column:
    """A text of the same length, its code points folded one by one."""
    odd = {k: f for k, f in point_folds().items() if chr(k).lower() != f and k != 0x130}
    lower = F.lower(F.translate(_c(text), "\u0130", "i"))
    return F.translate(lower, "".join(map(chr, odd)), "".join(odd.values()))


def casefolded(text: Column | str) -> Column:
    """What texts share that differ in case only, by full folding: the sharp s and two s are one.

    Lower, upper and lower case one after the other expand what has an upper case of several letters. The dotless i,
    whose upper case is that of i, is kept apart from it; the final sigma is a sigma.
    """
    kept = F.translate(F.lower(_c(text)), "\u0131", "\ue131")
    # Of changes of case that follow each other directly Spark keeps the last only.
    return F.translate(F.lower(F.translate(F.upper(kept), "\ue131", "\u0131")), "\u03c2", "\u03c3")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open interval overlap; touching intervals don't overlap."""
    return (a_start < b_end) & (b_start < a_end)


def span_struct(arrival: Column, source: str, start: Column, end: Column, text: Column, kind: Column, confidence: Column, reason: Column, normalized: Column | None = None) -> Column:
    """A candidate of a layer as a struct: the columns of a table of candidates but for doc_id."""
    prefix = {"dictionary": "dict"}.get(source, source)
    norm = F.lit(None).cast("string") if normalized is None else normalized
    return F.struct(
        arrival.alias("arrival"), F.concat(F.lit(f"{prefix}:"), start, F.lit("-"), end).alias("id"), start.alias("start"), end.alias("end"), text.alias("text"), kind.alias("type"),
        confidence.cast("double").alias("confidence"), F.lit(source).alias("source"), reason.alias("reason"), norm.alias("normalized_value"),
    )


def piece(text: Column | str, start: Column, end: Column) -> Column:
    """The slice [start, end) by code points."""
    return _c(text).substr(start + 1, end - start)


def digits(value: Column | str) -> Column:
    """The value's digits."""
    return F.regexp_replace(_c(value), r"(?U)\D", "")


def luhn_ok(value: Column) -> Column:
    """13 to 19 digits with a valid check sum."""
    return F.length(value).between(13, 19) & F.coalesce(F.call_function("luhn_check", value), F.lit(False))


def canonical_phone(value: Column | str) -> Column:
    """Subscriber digits: one leading 0 is dropped, else a leading 61."""
    d = digits(value)
    return F.when(d.startswith("0"), d.substr(F.lit(2), F.length(d))).when(d.startswith("61"), d.substr(F.lit(3), F.length(d))).otherwise(d)


def _filled(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def link_key(pii_type: Column | str, normalized: Column | str) -> Column:
    """What links occurrences of one value; null never links."""
    kind, value = _c(pii_type), _c(normalized)
    return F.when(_filled(value), F.concat(kind, F.lit(":"), F.when(kind == "PHONE", canonical_phone(value)).otherwise(value)))


def identity_key(pii_type: Column | str, normalized: Column | str, text: Column | str) -> Column:
    """What shares one replacement token: the linked value, else the text without its case."""
    kind, value = _c(pii_type), _c(normalized)
    own = F.when((kind == "PHONE") & _filled(value), canonical_phone(value)).when(_filled(value), value).otherwise(casefolded(text))
    return F.concat(kind, F.lit("\0"), own)


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")


def _tail(text: Column, pattern: str) -> Column:
    """What a pattern matches read from the end; a search for a match up to the end would start anew at each character."""
    return F.reverse(F.regexp_extract(F.reverse(text), pattern, 0))


def sentence(text: Column | str, start: Column, end: Column) -> Column:
    """The sentence around a span, between . ! ? or line feeds, without them."""
    left = _tail(_c(text).substr(F.lit(1), start), r"^[^.!?\n]*")
    right = F.regexp_extract(_c(text).substr(end + 1, F.length(_c(text))), r"^[^.!?\n]*", 0)
    return _stripped(F.concat(left, piece(text, start, end), right))


def model_sentence(text: Column | str, start: Column, end: Column) -> Column:
    """The sentence shown to a model: between full stops or line feeds, with the one that ends it."""
    left = _tail(_c(text).substr(F.lit(1), start), r"^[^.\n]*")
    right = F.regexp_extract(_c(text).substr(end + 1, F.length(_c(text))), r"^[^.\n]*[.\n]?", 0)
    return _stripped(F.concat(left, piece(text, start, end), right))


def unfenced(reply: Column | str) -> Column:
    """A model's reply without a code fence around it."""
    bare = _stripped(_c(reply))
    inner = _stripped(F.regexp_replace(F.regexp_replace(bare, r"^```[a-zA-Z]*\n?", ""), r"\n?```\z", ""))
    return F.when(bare.startswith("```"), inner).otherwise(bare)


def mapped_type(raw: Column | str) -> Column:
    """A known type in upper case, else OTHER."""
    name = F.upper(F.trim(_c(raw)))
    return F.when(name.isin(*PII_TYPES), name).otherwise("OTHER")


def reason_or(given: Column | str, fallback: str) -> Column:
    """A trimmed reason that isn't empty, else the fallback."""
    return F.coalesce(F.nullif(_stripped(_c(given)), F.lit("")), F.lit(fallback))


def token(mode: Column | str, pii_type: Column | str, number: Column) -> Column:
    """The replacement of a value: a constant marker, or its type and number."""
    return F.when(_c(mode) == "REDACT", F.lit(REDACT_MARKER)).otherwise(F.concat(F.lit("["), _c(pii_type), F.lit("_"), number.cast("string"), F.lit("]")))


def blackout(start: Column, end: Column) -> Column:
    """Blocks as long as the value."""
    return F.repeat(F.lit("█"), end - start)


def screen_marker(mode: Column | str, pii_type: Column | str, start: Column, end: Column) -> Column:
    """What the screen shows in place of a value: at least three blocks, or its type."""
    return F.when(_c(mode) == "REDACT", F.repeat(F.lit("█"), F.greatest(F.lit(3), end - start))).otherwise(F.concat(F.lit("["), _c(pii_type), F.lit("]")))


def confidence_word(confidence: Column | str) -> Column:
    c = _c(confidence)
    return F.when(c >= 0.95, "certain").when(c >= 0.8, "strong").when(c >= 0.6, "likely").otherwise("weak")


def confidence_opacity(confidence: Column | str) -> Column:
    return F.lit(0.35) + F.lit(0.65) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(confidence)))


def places(linked_count: Column | str) -> Column:
    """How many places one decision settles."""
    return _c(linked_count) + 1


def capped(score: Column | str, ceiling: float) -> Column:
    """A score cut at the ceiling and rounded to two digits, half to even."""
    return F.bround(F.least(_c(score), F.lit(ceiling)), 2)


def highlight(sentence: Column | str, value: Column | str) -> Column:
    """The sentence in three parts, the middle one being the value at its first place; between dots where it isn't there."""
    whole, v = _c(sentence), _c(value)
    at = F.position(v, whole)
    return F.struct(
        F.when(at > 0, whole.substr(F.lit(1), at - 1)).otherwise("… ").alias("before"),
        v.alias("marked"),
        F.when(at > 0, whole.substr(at + F.length(v), F.length(whole))).otherwise(" …").alias("after"),
    )


def from_utf16(text: Column | str, units: Column) -> Column:
    """How many code points begin within the first ``units`` UTF-16 units, in which screens count."""
    filler = "\uffff"
    wide = F.regexp_replace(F.replace(_c(text), F.lit(filler), F.lit("x")), r"([\x{10000}-\x{10FFFF}])", f"$1{filler}")
    return F.length(F.replace(wide.substr(F.lit(1), units), F.lit(filler), F.lit("")))


def selected_range(text: Column | str, anchor: Column, focus: Column) -> Column:
    """The range (start, end) between two places in either order; null for one that holds nothing but white space."""
    start, end = F.least(anchor, focus), F.greatest(anchor, focus)
    return F.when((start < end) & piece(text, start, end).rlike(r"(?U)\S"), F.struct(start.alias("start"), end.alias("end")))
