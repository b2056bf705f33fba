"""The name and address layer: any analyser that yields typed ranges, whitelisted, suppressed, capped and resolved.

The default analyser is a set of bounded patterns; a statistical one may be passed in as a function over batches of
texts. Its libraries aren't part of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contract import CONFIDENCE
from ..functions.matching import all_matches, any_of, greedy
from ..functions.scalars import capped, overlaps, piece, span_struct

# The entity types this layer owns, with their span type.
ENTITY_MAP = {"PERSON": "PERSON", "ORGANIZATION": "ORG", "ORG": "ORG", "LOCATION": "ADDRESS", "STREET_ADDRESS": "ADDRESS"}
#: What a finding's reason calls its entity type, after "name rules" or "the analyser".
CALLED = {"PERSON": "took this for a person name", "ORGANIZATION": "took this for an organisation", "ORG": "took this for an organisation", "LOCATION": "took this for a location", "STREET_ADDRESS": "matched a full street address"}
# The street types of an address.
STREET_TYPES = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Boulevard|Blvd|Way|Terrace|Tce|Crescent|Cres"
#: From a street type on, the rest of its line up to a number of four digits.
STREET_END = rf"(?:{STREET_TYPES})\b[^\n]*?\b\d{{4}}\b"
#: A street address: a number, a capitalised word, any words up to the first street type that such a number follows. The
#: words are possessive, as Java's matcher would need stack for each to come back to.
STREET_ADDRESS = rf"(?U)\b\d{{1,5}}\s+[A-Z][A-Za-z]+(?:\s++(?!{STREET_END})[A-Za-z]++)*+\s+{STREET_END}"
NAME = r"[A-Z][a-zà-öø-ÿ]+(?:[ -][A-Z][a-zà-öø-ÿ]+){0,3}"
#: Words that a comma and a name may follow.
RELATIONS = "supervisor|manager|colleague|partner|spouse|wife|husband|mother|father|son|daughter|brother|sister|friend|landlord|tenant|assistant|director|officer|doctor|nurse"
RESULT = "array<struct<start:int,end:int,entity:string,score:double>>"
ALLOWED = "array<struct<start:int,end:int>>"
NAMED = "struct<start:int,end:int,type:string,reason:string,confidence:double>"


@dataclass(frozen=True)
class Recogniser:
    """A pattern (Java) for an entity type. With ``cue``, matches start after a match of that pattern.

    Every match, with its cue, holds one of the literals ``needs``, if there are any: other texts aren't searched.
    """

    entity: str
    pattern: str
    score: float
    cue: str = ""
    needs: tuple[str, ...] = ()


DEFAULT_RECOGNISERS = (
    Recogniser("STREET_ADDRESS", STREET_ADDRESS, 0.8, needs=tuple(STREET_TYPES.split("|"))),
    Recogniser("PERSON", NAME, 0.85, cue=r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.? ", needs=("Mr", "Ms", "Miss", "Dr", "Prof")),
    Recogniser("PERSON", r"[A-Z][a-zà-öø-ÿ]+ [A-Z][a-zà-öø-ÿ]+", 0.75, cue=rf"\b(?:{RELATIONS}), ", needs=tuple(f"{x}, " for x in RELATIONS.split("|"))),
    Recogniser("PERSON", r"(?<=[.!?\n] )[A-Z][a-zà-öø-ÿ]+(?= (?:has|said|asked|called|confirmed|told|wrote) )", 0.6),
    Recogniser("ORGANIZATION", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){0,3} (?:Mutual|Ltd|Limited|Inc|Pty|Bank|Group|Court|University)\b", 0.7, needs=(" Mutual", " Ltd", " Limited", " Inc", " Pty", " Bank", " Group", " Court", " University")),
)

Analyser = Callable[[pd.Series], pd.Series]


def pattern_results(text: Column | str, recognisers: Sequence[Recogniser] = DEFAULT_RECOGNISERS) -> Column:
    """What the recognisers find: array of start, end, entity, score."""
    parts = [_recognised(text, r) for r in recognisers]
    return F.concat(*parts) if parts else F.array().cast(RESULT)


def _recognised(text: Column | str, r: Recogniser) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    found = all_matches(text, f"(?:{r.cue})(?:{r.pattern})" if r.cue else r.pattern, any_of(text, r.needs) if r.needs else None)

    def lead(m: Column) -> Column:
        return F.length(F.regexp_extract(m["text"], f"^(?:{r.cue})", 0)) if r.cue else F.lit(0)

    return F.transform(found, lambda m: F.struct((m["start"] + lead(m)).alias("start"), m["end"].alias("end"), F.lit(r.entity).alias("entity"), F.lit(r.score).alias("score")))


def analysed(documents: DataFrame, analyser: Analyser | None = None, recognisers: Sequence[Recogniser] = DEFAULT_RECOGNISERS) -> DataFrame:
    """doc_id, text and ``found``. ``analyser`` maps a batch of texts to lists of {start, end, entity, score}."""
    if analyser is None:
        return documents.select("doc_id", "text", pattern_results("text", recognisers).alias("found"))
    return documents.select("doc_id", "text", F.pandas_udf(analyser, RESULT)("text").alias("found"))


def detect_names(documents: DataFrame, ranges: DataFrame | None = None, analyser: Analyser | None = None, recognisers: Sequence[Recogniser] = DEFAULT_RECOGNISERS) -> DataFrame:
    """Candidates of persons, organisations and addresses.

    Entities of other types are dropped; so are those that overlap a harmless range, before overlaps between the
    rest are resolved (a suppressed long candidate must not hide a short one). Longer candidates win, then those of
    higher confidence, then earlier ones.
    """
    who = "name rules" if analyser is None else "the analyser"
    rows = analysed(documents, analyser, recognisers)
    allowed = F.array().cast(ALLOWED)
    if ranges is not None:
        own = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("allowed"))
        rows, allowed = rows.join(own, "doc_id", "left"), F.coalesce("allowed", allowed)
    return rows.select("doc_id", F.explode(name_rows(F.col("text"), F.col("found"), allowed, who)).alias("c")).select("doc_id", "c.*")


def name_rows(text: Column, found: Column, allowed: Column, who: str = "name rules") -> Column:
    """The layer's candidates, of what was found in a text and the harmless ranges (start, end), as an array of structs."""
    kinds = F.create_map(*[F.lit(x) for pair in ENTITY_MAP.items() for x in pair])
    reasons = F.create_map(*[F.lit(x) for e, called in CALLED.items() for x in (e, f"{who} {called}")])
    owned = F.filter(found, lambda c: c["entity"].isin(*ENTITY_MAP) & ~F.exists(allowed, lambda a: overlaps(c["start"], c["end"], a["start"], a["end"])))
    shaped = F.transform(owned, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.element_at(kinds, c["entity"]).alias("type"), F.element_at(reasons, c["entity"]).alias("reason"), capped(c["score"], CONFIDENCE["ner"]).alias("confidence")))
    kept = greedy(shaped, [lambda c: c["start"] - c["end"], lambda c: -c["confidence"], lambda c: c["start"]], NAMED)
    return F.transform(kept, lambda c, k: span_struct(F.lit(2 << 40) + k, "ner", c["start"], c["end"], piece(text, c["start"], c["end"]), c["type"], c["confidence"], c["reason"]))
