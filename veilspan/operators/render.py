"""Rendering of accepted spans: redacted or anonymised text, and a legend without values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import appended, buffer, disjoint, none, unrolled
from ..functions.scalars import blackout, identity_key, piece, screen_marker, token
from .spans import overlapping


def numbered(accepted: DataFrame) -> DataFrame:
    """Adds ``identity`` and ``number``: entities of a type are numbered in a document by first occurrence."""
    own = accepted.withColumn("identity", identity_key("type", "normalized_value", "text"))
    first = own.withColumn("first", F.min("start").over(Window.partitionBy("doc_id", "identity")))
    # Empty spans may share a start, so the identity settles ties.
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy("doc_id", "type").orderBy("first", "identity"))).drop("first")


def tokens(accepted: DataFrame, mode: str) -> DataFrame:
    """Adds ``token`` for the mode REDACT or ANONYMIZE."""
    return numbered(accepted).withColumn("token", token(F.lit(mode), "type", F.col("number")))


def legend(accepted: DataFrame, mode: str) -> DataFrame:
    """A row for each entity: doc_id, token, type, occurrences, ord (by first occurrence)."""
    rows = tokens(accepted, mode).groupBy("doc_id", "identity", "token", "type").agg(F.count("*").alias("occurrences"), F.min("start").alias("first"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "identity"))).select("doc_id", "token", "type", "occurrences", "ord")


def rendered(documents: DataFrame, accepted: DataFrame, mode: str, style: str = "token") -> DataFrame:
    """doc_id, output_text for every document; ``error`` where accepted spans overlap (then there is no text).

    Only the gaps between spans are copied. Style ``blackout`` puts blocks as long as the values.
    """
    spans = tokens(accepted, mode)
    if style == "blackout":
        spans = spans.withColumn("token", blackout(F.col("start"), F.col("end")))
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("spans"))
    clashes = overlapping(accepted).groupBy("doc_id").agg(F.lit("overlapping_accepted_spans").alias("error"))
    rows = documents.select("doc_id", "text").join(lists, "doc_id", "left").join(clashes, "doc_id", "left")
    text = F.col("text")
    state = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,token:string>>")),
        F.struct(F.lit(0).alias("at"), buffer("string").alias("out")),
        lambda s, x: F.struct(x["end"].alias("at"), appended(s["out"], F.concat(piece(text, s["at"], x["start"]), x["token"])).alias("out")),
        lambda s: F.concat(F.array_join(unrolled(s["out"]), ""), piece(text, s["at"], F.length(text))),
    )
    return rows.select("doc_id", F.when(F.col("error").isNull(), state).alias("output_text"), "error")


def segments(documents: DataFrame, items: DataFrame, mode: str) -> DataFrame:
    """What the screen shows: doc_id, ord, start, end, kind (text or span), shown.

    Accepted and pending items are taken by start; one that overlaps an item before it is skipped; gaps are filled.
    """
    shown = items.where(F.col("status").isin("accepted", "pending")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", "status"))).alias("items"))
    kind = "struct<start:int,end:int,type:string,status:string>"
    kept = disjoint(F.col("items"), kind)
    rows = documents.select("doc_id", "text").join(shown, "doc_id", "left").withColumn("kept", F.coalesce(kept, none(kind)))
    spans = rows.select("doc_id", "text", F.explode("kept").alias("x")).select("doc_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.lit("span").alias("kind"), F.when(F.col("x.status") == "accepted", screen_marker(F.lit(mode), F.col("x.type"), F.col("x.start"), F.col("x.end"))).otherwise(F.expr("substr(text, x.start + 1, x.end - x.start)")).alias("shown"))
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("kept", lambda x: F.array(x["start"], x["end"]))), F.array(F.length("text")))
    gaps = rows.select("doc_id", "text", F.explode(F.transform(F.sequence(F.lit(0), F.size("kept")), lambda k: F.struct(F.element_at(edges, 2 * k + 1).alias("start"), F.element_at(edges, 2 * k + 2).alias("end")))).alias("x"))
    gaps = gaps.where("x.start < x.end").select("doc_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.lit("text").alias("kind"), F.expr("substr(text, x.start + 1, x.end - x.start)").alias("shown"))
    both = spans.unionByName(gaps)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "kind"))).select("doc_id", "ord", "start", "end", "kind", "shown")
