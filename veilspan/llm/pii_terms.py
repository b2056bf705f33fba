"""Personal data: base patterns, and an information-theoretic pass for terms that give protected entities away.

The values that the base patterns find (e-mail addresses, IP addresses, cards, phone numbers) are the protected
entities. Over the corpus, p(e) is the share of documents that hold entity e, p(t) that of documents that hold term
t, and p(t, e) that of documents in which t stands among the ``window`` terms on either side of e. The pointwise
mutual information PMI(t; e) = log p(t, e) / (p(t) p(e)) is at most the entity's own information IC(e) = -log p(e),
reached when every document with t holds e. A term whose PMI reaches ``threshold`` times IC(e) discloses e: wherever
it stands in the corpus, with or without e, it is generalised, if its form has a class (a number, a name), and
removed otherwise.

Two passes over the texts: the first gathers the statistics, the second marks the base spans and the terms found to
disclose something. The terms are broadcast up to a bound; beyond it each document gets its own by joins.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, tidy

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TERM = re.compile(r"[^\W_](?:[^\W_]|['-](?=[^\W_]))*")
#: A term of more characters is named by a digest in the statistics.
LONGEST_TERM = 64
#: A task passes its counts on when it holds so many terms.
HELD_TERMS = 100_000
#: Disclosing terms are broadcast up to so many, of so many characters together, and joined beyond.
BROADCAST_TERMS, BROADCAST_CHARS = 200_000, 4_000_000


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in linear time.

    Runs of local characters end at an @ or don't count, so each @ has one possible start.
    """
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        floor = domain.end() if domain else at + 1
        if domain:
            found.append((start, floor))
        at = text.find("@", floor)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x[-4:]) <= 255 if len(x.lstrip("0")) <= 3 else False for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return found


def entity(kind: str, value: str) -> str:
    """The name of a protected entity: its kind and its value in one form."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else ''.join(DIGIT.findall(value))}"


def key_of(term: str) -> str:
    """The name of a term: the whole term in lower case, or a digest of it."""
    own = term.lower()
    return own if len(own) <= LONGEST_TERM else f"~{hashlib.blake2b(own.encode(), digest_size=16).hexdigest()}"


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the terms that overlap no base span, in order."""
    taken, out = iter(sorted((a, b) for _, a, b in spans)), []
    low, reach = next(taken, (len(text), 0))
    ends = 0  # the furthest end of the spans that start before the term at hand ends
    for m in TERM.finditer(text):
        a, b = m.span()
        while low < b:
            ends = max(ends, reach)
            low, reach = next(taken, (len(text), 0))
        if ends <= a:
            out.append((a, b))
    return out


def near_terms(text: str, spans: list[tuple[str, int, int]], window: int) -> list[tuple[str, str, int, int, int]]:
    """(entity, term, start, end, context) of the up to ``window`` terms on either side of each span.

    Terms overlapping a base span are no terms. The context is a hash of the terms of that window.
    """
    if not spans:
        return []
    out, terms = [], free_terms(text, spans)
    starts, ends = [a for a, _ in terms], [b for _, b in terms]
    for kind, start, end in spans:
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        around = [(a, b, key_of(text[a:b])) for a, b in terms[max(0, before - window) : before] + terms[after : after + window]]
        context = int.from_bytes(hashlib.blake2b(" ".join(t for *_, t in around).encode(), digest_size=8).digest(), "little", signed=True)
        out += [(entity(kind, text[start:end]), t, a, b, context) for a, b, t in around]
    return out


def marked(text: str, wanted: frozenset[str] | set[str]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans of a text, and the spans of its terms that are among the ``wanted`` ones."""
    spans = base_spans(text)
    if not wanted or not any(key_of(t) in wanted for t in set(TERM.findall(text))):
        return spans, []
    return spans, [("term", a, b) for a, b in free_terms(text, spans) if key_of(text[a:b]) in wanted]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_key long, doc_id long, entity string, term string, low long, high long, n long"


def _doc_key() -> Column:
    """A number that equal rows share."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def scan(documents: DataFrame, window: int) -> DataFrame:
    """One pass over all texts: what the statistics are made of, every row of the table counting once.

    A row with entity and term says that the term stands near the entity in a document, with the least and the largest
    hash of the windows that they share; one with an entity, that the document holds it; one with a term, in how many
    of a task's documents it stands (``n``); one with neither, how many documents a task has read. ``doc_key`` is made of
    the id and the text, so equal rows share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        rows: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), layout, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=layout)

        def counted() -> pa.RecordBatch:
            none = pa.nulls(len(counts))
            made = {f.name: none.cast(f.type) for f in layout} | {"term": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())}
            counts.clear()
            return pa.RecordBatch.from_pydict(made, schema=layout)

        for batch in batches:
            for part, texts in slices(batch):
                for key, i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                    counts.update({key_of(t) for t in set(TERM.findall(text))})
                    spans = base_spans(text)
                    rows += [(key, i, e, None, None, None, 1) for e in {entity(k, text[a:b]) for k, a, b in spans}]
                    pairs: dict[tuple[str, str], tuple[int, int]] = {}
                    for e, t, _, _, context in near_terms(text, spans, window):
                        low, high = pairs.get((e, t), (context, context))
                        pairs[e, t] = min(low, context), max(high, context)
                    rows += [(key, i, e, t, low, high, 1) for (e, t), (low, high) in pairs.items()]
                    if len(rows) > HELD_TERMS:
                        yield told()
                rows.append((None, None, None, None, None, None, len(texts)))
                yield told()
                if len(counts) > HELD_TERMS:
                    yield counted()
        yield counted()

    layout = pa.schema([("doc_key", pa.int64()), ("doc_id", pa.int64()), ("entity", pa.string()), ("term", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64())])
    return documents.select(_doc_key().alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), FOUND)


def disclosing(found: DataFrame, threshold: float, support: int) -> DataFrame:
    """The (entity, term) pairs whose disclosure PMI / IC reaches the threshold.

    All four counts are of rows, so a table whose rows all stand k times gives the same pairs. A pair also needs
    ``support`` different documents and two different contexts, so that copies of one passage aren't evidence.
    """
    total = max(2, found.where("entity is null and term is null").agg(F.sum("n")).first()[0] or 0)
    near = found.where("entity is not null and term is not null")
    together = near.groupBy("entity", "term", "doc_id", "doc_key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    together = together.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_documents"), F.min("low").alias("low"), F.max("high").alias("high")).where((F.col("n_documents") >= support) & (F.col("low") != F.col("high")))
    holders = found.where("entity is not null and term is null").groupBy("entity").agg(F.sum("n").alias("n_entity"))
    frequencies = found.where("entity is null and term is not null").groupBy("term").agg(F.sum("n").alias("n_term"))
    scored = together.join(holders, "entity").join(frequencies, "term")
    pmi = F.log(F.lit(float(total)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    return scored.withColumn("disclosure", pmi / F.log(F.lit(float(total)) / F.least("n_entity", F.lit(total - 1)))).where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


def unjudged(found: DataFrame, support: int = 2) -> DataFrame:
    """``entities, judged long``: how many entities a scan has, and of how many any pair has what judging it needs."""
    near = found.where("entity is not null and term is not null").groupBy("entity", "term").agg(F.count_distinct(F.struct("doc_id", "doc_key")).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    able = near.where((F.col("n") >= support) & (F.col("low") != F.col("high"))).select("entity").distinct().withColumn("able", F.lit(1))
    every = found.where("entity is not null and term is null").select("entity").distinct()
    return every.join(able, "entity", "left").agg(F.count("*").alias("entities"), F.count("able").alias("judged"))


Rewrite = Callable[[pa.RecordBatch, list[str], list[tuple[list, list]]], pa.RecordBatch]


def with_spans(documents: DataFrame, rewrite: Rewrite, schema, window: int = 5, threshold: float = 0.8, support: int = 2) -> DataFrame:
    """What ``rewrite`` makes of slices of all rows, their texts, and the base spans and term spans of each text."""
    pairs = stored(disclosing(stored(scan(documents, window), "personal"), threshold, support), "disclosing")
    terms = stored(pairs.select("term").distinct(), "terms")
    n, chars = terms.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if n <= BROADCAST_TERMS and chars <= BROADCAST_CHARS:
        shared = documents.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch):
                    yield rewrite(part, texts, [marked(t, shared.value) for t in texts])

        return documents.mapInArrow(tidy(run), schema)
    own = "veilspan doc key", "veilspan terms"
    keyed = documents.withColumn(own[0], _doc_key())
    held = keyed.select(F.col(f"`{own[0]}`").alias("doc_key"), "text").mapInArrow(tidy(_distinct_terms), "doc_key long, term string").distinct()
    lists = held.join(terms, "term").groupBy(F.col("doc_key").alias(own[0])).agg(F.collect_set("term").alias(own[1]))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                wanted = [set(x or ()) for x in part.column(part.num_columns - 1).to_pylist()]
                yield rewrite(part.select(part.schema.names[:-1]), texts, [marked(t, w) for t, w in zip(texts, wanted, strict=True)])

    joined_ = keyed.join(stored(lists, "lists"), own[0], "left").select(*[F.col(f"`{c}`") for c in documents.columns], F.col(f"`{own[1]}`"))
    return joined_.mapInArrow(tidy(run_joined), schema)


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch):
            for key, text in zip(part.column(0).to_pylist(), texts, strict=True):
                terms = list({key_of(t) for t in set(TERM.findall(text))})
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(terms), pa.int64()), pa.array(terms, pa.string())], names=["doc_key", "term"])


def personal_data(documents: DataFrame, **options) -> DataFrame:
    """Finds personal data in every whole text.

    Returns a row for each row: ``doc_id, n_email, n_ip, n_card, n_phone long, base_sha256, spans string``. Spans are
    ``kind:start:end`` in code points, end exclusive, joined by commas; those of disclosing terms have kind ``term``
    and stand last. A null text counts as empty. Repeated rows and rows with equal or null ids get rows of their own;
    further columns are ignored; an empty table gives no rows.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def rewrite(part: pa.RecordBatch, texts: list[str], spans: list[tuple[list, list]]) -> pa.RecordBatch:
        kinds = [Counter(k for k, *_ in base) for base, _ in spans]
        digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in spans]
        counts = [pa.array([c[k] for c in kinds], pa.int64()) for k in KINDS]
        return pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(base + terms) for base, terms in spans], pa.string())], names=[x.split()[0] for x in schema.split(", ")])

    return with_spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rewrite, schema, **options)


def generalised(term: str) -> str:
    """What stands in place of a disclosing term: the class of its form, or nothing."""
    if term[:1].isdigit():
        return "[NUMBER]"
    return "[NAME]" if term[:1].isupper() else ""


def cleaned(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with base spans replaced by their kind and terms generalised or removed; of overlapping spans one stands."""
    out, at = [], 0
    for start, end, kind in sorted(((a, b, k) for k, a, b in spans), key=lambda s: (s[0], -s[1], s[2])):
        if end <= at:
            continue
        start = max(start, at)
        out += [text[at:start], generalised(text[start:end]) if kind == "term" else f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def sanitise(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with personal data taken out of the texts and ``n_chars`` set anew, if there is such a column.

    All rows and columns are kept, whatever the columns' names; texts without spans stay as they are, a null text stays
    null; repeated rows and rows with equal or null ids are treated alike; an empty table gives no rows.
    """

    def rewrite(part: pa.RecordBatch, texts: list[str], spans: list[tuple[list, list]]) -> pa.RecordBatch:
        at = part.schema.get_field_index("text")
        null = part.column(at).is_null().to_pylist()
        made = [None if gone else cleaned(t, base + terms) if base or terms else t for gone, t, (base, terms) in zip(null, texts, spans, strict=True)]
        columns = list(part.columns)
        columns[at] = pa.array(made, part.schema.field(at).type)
        if (size := part.schema.get_field_index("n_chars")) >= 0:
            columns[size] = pa.array([None if t is None else len(t) for t in made], pa.int64()).cast(part.schema.field(size).type)
        return pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return with_spans(documents, rewrite, documents.schema, **options)
