"""The dictionary layer: whole-word terms of known entities, and ranges of terms that are known to be harmless."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import ALLOWLIST_REASON, CONFIDENCE, DEFAULT_ALLOWLIST, PII_TYPES
from ..functions.matching import MATCH, all_matches, disjoint, may_hold, whole_word
from ..functions.scalars import point_folded, span_struct
from .automaton import scanned

#: Term lists of up to so many entries become one projection over the text; longer ones are found by automata.
INLINE_TERMS = 200
#: Characters of terms in one automaton, and how many automata read the texts one after the other; beyond, terms are joined on
#: their first word.
AUTOMATON_CHARS, AUTOMATA = 2_000_000, 8
#: A word that more terms hold is told apart by a broadcast.
HOT_TERMS = 10_000
#: A table of terms is broadcast up to so many terms, and so many characters if all were as long as the longest.
BROADCAST_TERMS, BROADCAST_CHARS = 100_000, 16_000_000


def term_matches(text: Column | str, term: str, lowered: Column | None = None) -> Column:
    """Every whole-word, case-insensitive match; none for an empty term.

    With ``lowered``, the text in lower case, texts that can't hold a term of ASCII characters aren't searched for it.
    """
    gate = may_hold(F.col(text) if isinstance(text, str) else text, lowered, term) if lowered is not None and term.isascii() else None
    return all_matches(text, whole_word(term), gate) if term else F.array().cast(f"array<{MATCH}>")


def _marked(matches: Column, ord_: int, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(F.lit(ord_).alias("ord"), F.lit(kind).alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")))


def _hits(text: Column | str, terms: Sequence[tuple[str, str]]) -> Column:
    """ord, type, start, end, text of every match of every (term, type), as an array."""
    text = F.col(text) if isinstance(text, str) else text
    named = [(k, term, kind) for k, (term, kind) in enumerate(terms) if term]
    if not named:
        return F.array().cast("array<struct<ord:int,type:string,start:int,end:int,text:string>>")
    # The text in lower case is named, so it is made once for all terms.
    hits = F.transform(F.array(F.lower(text)), lambda lowered: F.concat(*[_marked(term_matches(text, term, lowered), k, kind) for k, term, kind in named]))
    return F.element_at(hits, 1)


def known_rows(text: Column | str, terms: Sequence[tuple[str, str]]) -> Column:
    """The candidates of up to ``INLINE_TERMS`` (term, type) pairs as an array of structs."""
    return F.transform(_hits(text, terms), lambda m: _candidate(m["start"].cast("long") * 256 + m["ord"], m["start"], m["end"], m["text"], m["type"]))


def harmless_hits(text: Column | str, terms: Sequence[str]) -> Column:
    """start, end, text of the harmless terms in a text, as an array of structs."""
    return _hits(text, [(t, "") for t in terms])


def _candidate(place: Column, start: Column, end: Column, text: Column, kind: Column) -> Column:
    reason = F.concat(F.lit("exact match against the closed-world "), kind, F.lit(" list"))
    return span_struct(F.lit(1 << 40) + place, "dictionary", start, end, text, kind, F.lit(CONFIDENCE["dictionary"]), reason)


def occurring(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms (ord, term, type) all of whose words stand in some document, with ``word``, the word of theirs that the fewest
    terms hold, and ``lead``, where it starts in the term. Terms without a word have neither and stay.

    A term matches only where each of its words is a whole word of the text, so no other term can match. The result is computed at once and
    kept by Spark.
    """
    whole = F.lit(r"(?U)\w+")
    named = terms.where("term is not null and term <> ''").select(F.col("ord").cast("int").alias("ord"), "term", "type")
    held = documents.select(F.explode(F.array_distinct(F.regexp_extract_all("text", whole, F.lit(0)))).alias("word")).distinct()
    held = held.select(point_folded("word").alias("word")).distinct().withColumn("there", F.lit(True))
    words = F.regexp_extract_all("term", whole, F.lit(0))
    parts = named.select("ord", "term", "type", F.posexplode_outer(words).alias("k", "word")).withColumn("word", point_folded("word")).persist()
    # Of each word of a term, how many terms hold it and whether a text does; few words can be held by very many terms, and these are broadcast.
    known = parts.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).join(held, "word", "left").select("word", "n", F.coalesce("there", F.lit(False)).alias("there")).persist()
    hot = F.broadcast(known.where(F.col("n") > HOT_TERMS))
    told = parts.join(hot, "word").unionByName(parts.join(hot.select("word"), "word", "left_anti").join(known.where(F.col("n") <= HOT_TERMS), "word", "left"))
    rarest = F.min(F.when(F.col("word").isNotNull(), F.struct("n", "k", "word"))).alias("rarest")
    every = told.groupBy("ord", "term", "type").agg(rarest, F.bool_and(F.col("word").isNull() | F.col("there")).alias("there")).where("there")
    lead = F.try_element_at(all_matches("term", r"(?U)\w+"), F.col("rarest.k") + 1)["start"]
    kept = every.select("ord", "term", "type", "rarest.word", lead.alias("lead")).persist()
    kept.count()
    parts.unpersist()
    known.unpersist()
    return kept


def joined_terms(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The same for a table of terms (ord, term, type) of any size, joined on that word of each term which the fewest terms hold.

    Words of the documents are equi-joined with these, then the whole term is compared; matches of one term that overlap
    an earlier one of the same term are left out, as a scan from the left would. ``terms`` may be what ``occurring`` has kept.
    """
    named = terms if "lead" in terms.columns else occurring(documents, terms)
    longest, n = named.agg(F.max(F.length("term")), F.count("*")).first()
    longest, named = longest or 0, F.broadcast(named) if n <= BROADCAST_TERMS and n * (longest or 0) <= BROADCAST_CHARS else named
    words = documents.select("doc_id", "text", F.explode(all_matches("text", r"(?U)\w+")).alias("w"))
    words = words.select("doc_id", F.col("w.start").alias("at"), point_folded("w.text").alias("word"), F.col("text").substr(F.greatest(F.lit(1), F.col("w.start") + 1 - longest), F.lit(2 * longest + 2)).alias("near"), F.greatest(F.lit(0), F.col("w.start") - longest).alias("base"))
    met = words.join(named.where("word <> ''"), "word").withColumn("start", F.col("at") - F.col("lead")).where("start >= base")
    met = met.withColumn("end", F.col("start") + F.length("term")).withColumn("hit", F.expr("substr(near, start - base + 1, length(term))"))
    before, after = F.expr("substr(near, start - base, 1)"), F.expr("substr(near, end - base + 1, 1)")
    word_char = lambda c: c.rlike(r"(?U)\w")
    edge = lambda outer, inner: word_char(outer) != word_char(inner)
    first, last = F.expr("substr(hit, 1, 1)"), F.expr("substr(hit, length(hit), 1)")
    before = F.when(F.col("start") == F.col("base"), F.lit("")).otherwise(before)
    met = met.where((point_folded("hit") == point_folded("term")) & edge(before, first) & edge(after, last))
    group = met.groupBy("doc_id", "ord", "type").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("hit").alias("text")))).alias("m"))
    return group.select("doc_id", "ord", "type", F.explode(disjoint(F.col("m"), MATCH)).alias("x")).select("doc_id", "ord", "type", "x.start", "x.end", "x.text")


def scanned_terms(documents: DataFrame, terms: DataFrame) -> DataFrame | None:
    """The same by automata over whole texts, each built once a worker from a broadcast part of the terms; None if there
    are more terms than the automata take. Texts are read once for each automaton and nothing is shuffled."""
    named = terms.where("term is not null and term <> ''").select(F.col("ord").cast("int").alias("ord"), "term", "type")
    parts = _automata(named)
    if parts > AUTOMATA:
        return None
    found = [scanned(documents, named.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k) if parts > 1 else named) for k in range(parts)]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole if parts == 1 else whole.drop("place")


def _automata(terms: DataFrame) -> int:
    """How many automata a table of terms takes."""
    chars = terms.agg(F.sum(F.length("term"))).first()[0] or 0
    return max(1, -(-chars // AUTOMATON_CHARS))


def detect_known(documents: DataFrame, known: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """Candidates for known entities: (text, type) pairs, or a table (ord, term, type).

    Overlapping matches of different entities all stay, so ids may repeat. Their order in a document is that of their
    starts, then of their entities in the list. Of lists for more than one automaton only the terms whose words stand in the documents are searched.
    """
    if not isinstance(known, DataFrame):
        if any(t not in PII_TYPES for _, t in known):
            raise ValueError("an entity has an unknown type")
        if len(known) <= INLINE_TERMS:
            return documents.select("doc_id", F.explode(known_rows("text", known)).alias("c")).select("doc_id", "c.*")
        known = documents.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(known)], "ord int, term string, type string")
    if _automata(known) > 1:
        known = occurring(documents, known)
    found = scanned_terms(documents, known)
    return _candidates(joined_terms(documents, known) if found is None else found)


def _candidates(found: DataFrame) -> DataFrame:
    """Matches as candidates; ``arrival`` puts this layer's matches in a document in order, before those of later layers.

    Where the matches of a document come without ``place``, their number in that order, they are numbered by a window.
    """
    place = F.col("place") if "place" in found.columns else F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "ord"))
    return found.select("doc_id", _candidate(place, *(F.col(c) for c in ("start", "end", "text", "type"))).alias("c")).select("doc_id", "c.*")


def allow_ranges(documents: DataFrame, terms: Sequence[str] = DEFAULT_ALLOWLIST) -> DataFrame:
    """Ranges of harmless terms: doc_id, start, end, text, reason. They are not spans and have no type."""
    rows = documents.select("doc_id", F.explode(harmless_hits("text", terms)).alias("m"))
    return rows.select("doc_id", "m.start", "m.end", "m.text", F.lit(ALLOWLIST_REASON).alias("reason"))


def parse_entities(specs: Sequence[str]) -> list[tuple[str, str]]:
    """(text, type) of command-line arguments TEXT:TYPE, split at the last colon."""
    out = []
    for spec in specs:
        text, colon, kind = spec.rpartition(":")
        if not colon or kind not in PII_TYPES:
            raise ValueError(f"not TEXT:TYPE: {spec!r}")
        out.append((text, kind))
    return out
