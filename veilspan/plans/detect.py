"""The detection pipeline: all layers over a table of documents, merged into findings, with a report of the layers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contract import ALLOWLIST_REASON, CANDIDATES, DEFAULT_ALLOWLIST, LAYERS, PII_TYPES, fields
from ..functions.scalars import span_struct
from ..operators.dictionary import INLINE_TERMS, allow_ranges, detect_known, harmless_hits, known_rows
from ..operators.intervals import swept
from ..operators.merge import merge, merge_scan
from ..operators.model_layer import asked, detect_with_model, gated, text_windows
from ..operators.names import detect_names, name_rows, pattern_results
from ..operators.patterns import detect_patterns, pattern_rows


@dataclass
class Detection:
    """Candidates of all layers, the harmless ranges, merged findings, and the layers' report."""

    candidates: DataFrame
    ranges: DataFrame
    findings: DataFrame
    layers: DataFrame


def _rows(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields(CANDIDATES)])


def detect(documents: DataFrame, known: Sequence[tuple[str, str]] | DataFrame = (), allowlist: Sequence[str] = DEFAULT_ALLOWLIST, analyser=None, names: bool = True, client=None, keep: bool = False) -> Detection:
    """Runs patterns, dictionary, names and, with a ``client``, the model layer on rows (doc_id, text).

    Layers that need no other table are one projection of the documents, read once; only merging exchanges rows, by doc_id. Empty and null texts have no candidates, but their rows in the layers' report.
    With a ``client`` Spark keeps the candidates, so a model isn't asked again for what findings read twice. With ``keep`` it keeps what that projection finds, for jobs that read both findings and layers.
    """
    whole = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = whole.where(F.length("text") >= 1)
    if analyser is None and not isinstance(known, DataFrame) and len(known) <= INLINE_TERMS:
        rows, failed = scan(docs, known, allowlist, names), None
        rows = rows.persist() if keep else rows
        if client is not None:
            replies = asked(gated(text_windows(docs)), client)
            failed = _failed(replies)
            # One sweep tells which of the model's hits an earlier candidate covers, so neither texts nor replies are read again for it.
            every = rows.unionByName(_rows(detect_with_model(docs, replies=replies)).withColumn("harmless", F.lit(False))).persist()
            own = swept(every, ~F.col("harmless") & (F.col("source") != "llm"), "covered")
            rows = own.where("harmless or source <> 'llm' or not covered").drop("covered")
        found, ranges = rows.where("not harmless").drop("harmless"), rows.where("harmless").select("doc_id", "start", "end", "text", "reason")
        return Detection(found, ranges, merge_scan(rows), layer_report(whole, found, ranges, names, client is not None, failed, rows=rows))
    ranges = allow_ranges(docs, allowlist)
    found = _rows(detect_patterns(docs)).unionByName(_rows(detect_known(docs, known)))
    if names:
        found = found.unionByName(_rows(detect_names(docs, ranges, analyser)))
    failed = None
    if client is not None:
        replies = asked(gated(text_windows(docs)), client)
        failed = _failed(replies)
        found = found.unionByName(_rows(detect_with_model(docs, covered=found, replies=replies)))
    return Detection(found, ranges, merge(found, ranges), layer_report(whole, found, ranges, names, client is not None, failed, analyser))


def _failed(replies: DataFrame) -> DataFrame:
    return replies.where("failure is not null").groupBy("doc_id").agg(F.min("failure").alias("failure"))


def scan(documents: DataFrame, known: Sequence[tuple[str, str]], allowlist: Sequence[str], names: bool) -> DataFrame:
    """Candidates of the layers that need no other table, and ``harmless`` ranges, by one projection over the texts."""
    if any(t not in PII_TYPES for _, t in known):
        raise ValueError("an entity has an unknown type")
    text, none = F.col("text"), F.lit(None).cast("string")

    def rows_of(allowed: Column) -> Column:
        """The name layer's candidates and the ranges, of the harmless terms' places."""
        ranges = F.transform(allowed, lambda m: F.struct(F.lit(True).alias("harmless"), span_struct(F.lit(0).cast("long"), "allowlist", m["start"], m["end"], m["text"], none, F.lit(None), F.lit(ALLOWLIST_REASON)).alias("c")))
        return F.concat(ranges, _sound(name_rows(text, pattern_results(text), allowed))) if names else ranges

    every = F.concat(_sound(pattern_rows(text)), _sound(known_rows(text, known)), F.element_at(F.transform(F.array(harmless_hits(text, allowlist)), rows_of), 1))
    return documents.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.harmless", "x.c.*")


def _sound(candidates: Column) -> Column:
    return F.transform(candidates, lambda c: F.struct(F.lit(False).alias("harmless"), c.alias("c")))


def layer_report(documents: DataFrame, candidates: DataFrame, ranges: DataFrame, names: bool = True, model: bool = False, failed: DataFrame | None = None, analyser=None, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, name, status (ok, skipped, error), count, detail: a row for every document and layer.

    A layer that was switched off is skipped; the name layer's detail says whether house rules or an analyser ran. Errors inside a lazy plan can't be caught for a layer; the model's calls are, and mark the layer of a document.
    """
    spark = documents.sparkSession
    layers = [
        ("regex", "ok", "structured PII (phone/email/ID)"),
        ("dictionary", "ok", ""),
        ("ner", "ok", "names / addresses (rules)" if analyser is None else "names / addresses (analyser)") if names else ("ner", "skipped", "switched off"),
        ("llm", "ok", "relational/implicit PII") if model else ("llm", "skipped", "disabled (offline/no key)"),
    ]
    fixed = spark.createDataFrame(layers, "name string, status string, detail string")
    every = documents.select("doc_id").crossJoin(F.broadcast(fixed))  # four rows
    if rows is None:
        own = candidates.groupBy("doc_id", F.col("source").alias("name")).agg(F.count("*").alias("count"))
        allowed = ranges.groupBy("doc_id").agg(F.count("*").alias("allowed"))
        rows = every.join(own, ["doc_id", "name"], "left").join(allowed, "doc_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    else:
        tallies = rows.groupBy("doc_id").agg(*[F.count_if(~F.col("harmless") & (F.col("source") == x)).alias(x) for x in LAYERS], F.count_if("harmless").alias("allowed"))
        count = F.coalesce(*[F.when(F.col("name") == x, F.col(x)) for x in LAYERS], F.lit(0))
        rows = every.join(tallies, "doc_id", "left").withColumn("count", count).drop(*LAYERS)
    detail = F.when(F.col("name") == "dictionary", F.concat(F.lit("closed-world entities; "), F.coalesce("allowed", F.lit(0)), F.lit(" allowlisted range(s)"))).otherwise(F.col("detail"))
    rows = rows.withColumn("detail", detail).drop("allowed")
    if failed is not None:
        rows = rows.join(failed, "doc_id", "left")
        bad = (F.col("name") == "llm") & F.col("failure").isNotNull()
        rows = rows.withColumn("status", F.when(bad, "error").otherwise(F.col("status"))).withColumn("detail", F.when(bad, F.concat(F.lit("unavailable ("), F.col("failure"), F.lit(")"))).otherwise(F.col("detail"))).drop("failure")
    return rows.select("doc_id", "name", "status", "count", "detail")


def layer_tallies(layers: DataFrame) -> DataFrame:
    """How many layers of each document ran, were skipped or failed."""
    return layers.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "error")])
