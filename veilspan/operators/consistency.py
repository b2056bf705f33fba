"""Second looks at a document after redaction: occurrences, visible text, leaked parts, repeated values, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import all_matches, any_of, literal_places
from ..functions.scalars import link_key, piece
from .intervals import apart, pairs, touched
from .merge import clustered
from .model_layer import detect_with_model
from .render import rendered

#: What a second look takes for a network address, a link and a case number.
EXTRA_FORMATS = {"IP": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "URL": r"https?://[^\s<>\"']+", "POLICY": r"\b(?:[Pp]olicy|[Cc]ase|[Cc]laim) (?:[Nn]o\.? |[Nn]umber |#)?[A-Z0-9][A-Z0-9-]{3,30}\b"}
MIN_PART, MIN_CONFIDENCE = 3, 0.85
#: Lots that the parts of a document are dealt into.
LOTS = 64


def resolved_occurrences(documents: DataFrame, suggestions: DataFrame) -> DataFrame:
    """suggestions (doc_id, text, occurrence from 1) with start and end, null where there is no such occurrence."""
    rows = suggestions.withColumnRenamed("text", "value").join(documents.select("doc_id", F.col("text").alias("whole")), "doc_id")
    start = F.try_element_at(literal_places(F.col("whole"), F.col("value")), F.col("occurrence"))
    return rows.withColumn("start", start).withColumn("end", start + F.length("value")).withColumnRenamed("value", "text").drop("whole")


def visible(spans: DataFrame, hidden: DataFrame) -> DataFrame:
    """Spans that overlap none of the hidden ones."""
    return apart(spans, hidden)


def extra_formats(documents: DataFrame, hidden: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, text of further formats in the visible text."""
    text = F.col("text")
    gates = {"IP": text.rlike(r"[0-9]\.[0-9]"), "URL": any_of(text, ["http"]), "POLICY": any_of(text, ["olicy ", "ase ", "laim "])}
    parts = [F.transform(all_matches("text", p, gates[kind]), _kind(kind)) for kind, p in EXTRA_FORMATS.items()]
    rows = documents.select("doc_id", F.explode(F.concat(*parts)).alias("m")).select("doc_id", "m.*")
    return visible(rows, hidden)


def _kind(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"))


def leaked_parts(documents: DataFrame, hidden: DataFrame) -> DataFrame:
    """Words of at least three characters of confidently hidden values that still stand in the visible text."""
    word = rf"(?U)\w{{{MIN_PART},}}"
    parts = hidden.where(F.col("confidence") >= MIN_CONFIDENCE).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(word), F.lit(0))).alias("m")).select("doc_id", F.lower("m").alias("part"))
    dealt = parts.groupBy("doc_id", _lot(F.col("part")).alias("lot")).agg(F.collect_set("part").alias("parts"))
    lots = dealt.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("lot", "parts"))).alias("lots"))

    def hides(m):
        low = F.lower(m["text"])
        return F.coalesce(F.array_contains(F.try_element_at("lots", _lot(low)), low), F.lit(False))

    # Words are held against the parts where the text is, so only those that are parts are exchanged.
    words = documents.select("doc_id", "text").join(lots, "doc_id").select("doc_id", F.explode(F.filter(all_matches("text", word), hides)).alias("m")).select("doc_id", "m.start", "m.end", "m.text")
    return visible(words, hidden)


def _lot(word):
    """One of LOTS lots of a document's parts, so that a word is compared with few of them."""
    return F.pmod(F.xxhash64(word), F.lit(LOTS)).cast("int")


def repeated_values(spans: DataFrame, hidden: DataFrame) -> DataFrame:
    """Visible spans whose value stands at two or more visible places of the document."""
    keyed = visible(spans, hidden).withColumn("key", link_key("type", "normalized_value")).where("key is not null")
    return keyed.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "key"))).where("n >= 2").drop("n", "key")


def semantic_lens(documents: DataFrame, hidden: DataFrame, client) -> DataFrame:
    """doc_id, start, end, text of what a model still finds once the hidden spans are blacked out.

    Blocks are as long as what they hide, so offsets are those of the document. A document with a call that fails has none.
    """
    spans = hidden.select("doc_id", "start", "end", F.lit("").alias("text"), F.lit("OTHER").alias("type"), F.lit(None).cast("string").alias("normalized_value"))
    shown = rendered(documents, spans, "REDACT", "blackout").where("error is null").select("doc_id", F.col("output_text").alias("text"))
    return visible(detect_with_model(shown, client).select("doc_id", "start", "end", "text"), hidden)


def second_looks(documents: DataFrame, hidden: DataFrame, client=None) -> DataFrame:
    """doc_id, ord, start, end, text, lenses, severity: what each lens finds in the visible text, overlapping finds as one.

    Formats and leaked parts are suggestions; what only a model finds is for review, and nothing of this enters findings, so it
    can't hold an export back. In each document leaked parts come first, then formats, then the model's.
    """
    found = leaked_parts(documents, hidden).withColumn("lens", F.lit("consistency")).unionByName(extra_formats(documents, hidden).drop("kind").withColumn("lens", F.lit("format")))
    if client is not None:
        found = found.unionByName(semantic_lens(documents, hidden, client).withColumn("lens", F.lit("semantic")))
    islands = clustered(found.withColumn("arrival", F.lit(0)))
    whole = islands.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("lens")).alias("lenses"))
    severity = F.when(F.col("lenses") == F.array(F.lit("semantic")), "review").otherwise("suggest")
    risk = F.when(F.array_contains("lenses", "consistency"), 0).when(F.array_contains("lenses", "format"), 1).otherwise(2)
    order = Window.partitionBy("doc_id").orderBy(risk, "start")
    return slices(documents, whole.withColumn("severity", severity).withColumn("ord", F.row_number().over(order))).select("doc_id", "ord", "start", "end", "text", "lenses", "severity")


def scored(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall by type: a prediction that overlaps a true span of its type counts as found."""
    p, t = predicted.select("doc_id", "type", "start", "end"), truth.select("doc_id", "type", "start", "end")
    right = touched(p, t, ("doc_id", "type")).groupBy("type").agg(F.count("*").alias("right"))
    found = touched(t, p, ("doc_id", "type")).groupBy("type").agg(F.count("*").alias("found"))
    out = predicted.groupBy("type").agg(F.count("*").alias("predicted")).join(truth.groupBy("type").agg(F.count("*").alias("true")), "type", "full").join(right, "type", "left").join(found, "type", "left").na.fill(0)
    return out.select("type", "predicted", "true", F.try_divide("right", "predicted").alias("precision"), F.try_divide("found", "true").alias("recall"))


def conflicts(spans: DataFrame) -> DataFrame:
    """Pairs of one document's spans that overlap and differ in type."""
    own = spans.select("doc_id", "start", "end", "type")
    met = pairs(own, own).where("a.type < b.type")
    return met.select("doc_id", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("a", "b") for c in ("start", "end", "type")])


def slices(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with the slice they cover."""
    return spans.join(documents.select("doc_id", F.col("text").alias("whole")), "doc_id").withColumn("text", piece("whole", F.col("start"), F.col("end"))).drop("whole")
