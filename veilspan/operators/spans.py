"""Checks of spans against their documents, and lookups by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import SpanError
from ..functions.scalars import piece


def checked(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans with their text set to the slice, and ``error`` (code, detail), null where the span is sound.

    A span's offsets must lie in order within the text; a claimed text (column ``text``, may be null) must be the slice.
    """
    rows = spans.withColumnRenamed("text", "claimed").join(documents.select("doc_id", F.col("text").alias("whole")), "doc_id")
    sliced = piece("whole", F.col("start"), F.col("end"))
    sound = (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.length("whole"))
    code = F.when(~sound, "span_offsets_out_of_range").when(F.col("claimed").isNotNull() & (F.col("claimed") != sliced), "span_offset_mismatch")
    detail = F.concat(F.lit("["), F.col("start"), F.lit(", "), F.col("end"), F.lit(") of "), F.length("whole"))
    return rows.withColumn("text", F.when(sound, sliced)).withColumn("error", F.when(code.isNotNull(), F.struct(code.alias("code"), detail.alias("detail")))).drop("whole", "claimed")


def sound(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Sound spans; the first unsound one raises when the result is read."""
    rows = checked(spans, documents)
    stop = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("error.code"), F.lit(": "), F.col("error.detail"))).cast("string")).otherwise(F.col("text"))
    return rows.withColumn("text", stop).drop("error")


def unknown_ids(submitted: DataFrame, spans: DataFrame) -> DataFrame:
    """Submitted (doc_id, id) rows that the documents' spans don't have."""
    return submitted.join(spans.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def selected(submitted: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans of the submitted (doc_id, ord, id) rows in submitted order; an unknown id is an error."""
    missing = unknown_ids(submitted, spans).limit(5).collect()
    if missing:
        raise SpanError(400, "unknown_span_id", ", ".join(f"{r['doc_id']}:{r['id']}" for r in missing))
    return submitted.join(spans, ["doc_id", "id"]).orderBy("doc_id", "ord")


def overlapping(spans: DataFrame) -> DataFrame:
    """Neighbours that overlap, by (start, end): doc_id, start, end and the end before it. Empty for a disjoint set."""
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("start", "end"))
    return spans.select("doc_id", "start", "end", before.alias("previous_end")).where("start < previous_end")


def require_disjoint(spans: DataFrame) -> None:
    """Raises if any document's spans overlap."""
    clash = overlapping(spans).limit(1).collect()
    if clash:
        r = clash[0]
        raise SpanError(400, "overlapping_accepted_spans", f"document {r['doc_id']}: a span ending at {r['previous_end']} overlaps [{r['start']},{r['end']})")
