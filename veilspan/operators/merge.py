"""Merging: suppression, clusters of overlapping candidates, winners, links between equal values, tiers and ranks.

All of it is per document, so one exchange on doc_id serves every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import STRUCTURAL_SOURCES, TIER_HIGH, TIER_LOW_CONFIDENCE, TIER_SOFT_REVIEW
from ..functions.scalars import link_key, piece
from .intervals import apart, swept


def suppressed(candidates: DataFrame, ranges: DataFrame) -> DataFrame:
    """Candidates that overlap no harmless range, whatever layer they are from."""
    return apart(candidates, ranges)


def clustered(candidates: DataFrame) -> DataFrame:
    """Adds ``island``: candidates that overlap, directly or through others, share it; touching ones don't."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "arrival")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return candidates.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def winners(islands: DataFrame) -> DataFrame:
    """The candidate whose offsets, text and type stand for its island: structural first, then a model's, by confidence."""
    rank = F.when(F.col("source").isin(*STRUCTURAL_SOURCES), 0).when(F.col("source") == "llm", 1).otherwise(2)
    best = Window.partitionBy("doc_id", "island").orderBy(rank, F.desc("confidence"), "start", "end", "arrival")
    return islands.withColumn("n", F.row_number().over(best)).where("n = 1").select("doc_id", "island", "start", "end", "text", "type")


def facts(islands: DataFrame) -> DataFrame:
    """What an island gathers: highest confidence, sources, reasons in order, first normalised value."""
    reason = F.concat(F.lit("["), F.col("source"), F.lit("] "), F.col("reason"))
    return islands.groupBy("doc_id", "island").agg(
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "arrival", reason.alias("r")))), lambda x: x["r"])), " | ").alias("reason"),
        F.min_by("normalized_value", F.when(F.coalesce("normalized_value", F.lit("")) != "", F.struct("start", "end", "arrival"))).alias("normalized_value"),
    )


def tier(sources: Column | str, linked: Column) -> Column:
    """1: linked or structural; 3: a model's alone; 2: all else."""
    own = F.col(sources) if isinstance(sources, str) else sources
    return F.when(linked | F.arrays_overlap(own, F.array(*map(F.lit, STRUCTURAL_SOURCES))), TIER_HIGH).when(own == F.array(F.lit("llm")), TIER_SOFT_REVIEW).otherwise(TIER_LOW_CONFIDENCE)


def grouped(findings: DataFrame) -> DataFrame:
    """Adds ``link_group``, which findings of one value in a document share, and ``linked_count``, how many others there are.

    A finding that links with none has no group.
    """
    key = link_key("type", "normalized_value")
    # Findings without a key are groups of their own, so no window gathers them all.
    own = F.coalesce(key, F.concat(F.lit("\1"), F.col("start"), F.lit("-"), F.col("end")))
    counted = findings.withColumn("link_group", own).withColumn("linked_count", F.count("*").over(Window.partitionBy("doc_id", "link_group")) - 1)
    return counted.withColumn("link_group", F.when(F.col("linked_count") > 0, F.col("link_group")))


def linked(findings: DataFrame) -> DataFrame:
    """Adds ``linked`` to findings with groups: the other places of the same value in the document, in order.

    Each of k equal values gets k - 1 places. Jobs that need only the groups leave the column out, and it isn't computed.
    """
    every = F.collect_list(F.struct("start", "end")).over(Window.partitionBy("doc_id", F.coalesce("link_group", "id")))
    return findings.withColumn("linked", F.array_sort(F.filter(every, lambda o: (o["start"] != F.col("start")) | (o["end"] != F.col("end")))))


def with_groups(findings: DataFrame) -> DataFrame:
    """Findings with ``link_group`` and ``linked_count``; where they lack them, of their ``linked`` places."""
    if "link_group" in findings.columns:
        return findings
    first = F.array_min(F.array_append("linked", F.struct("start", "end")))
    group = F.when(F.size("linked") > 0, F.concat(first["start"], F.lit("-"), first["end"]))
    return findings.withColumn("link_group", group).withColumn("linked_count", F.size("linked").cast("long"))


def widened(best: DataFrame, islands: DataFrame, documents: DataFrame) -> DataFrame:
    """Winners with the offsets of their whole island, and the text between them; type and all else stay the winner's."""
    reach = islands.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    rows = best.drop("start", "end", "text").join(reach, ["doc_id", "island"]).join(documents.select("doc_id", F.col("text").alias("whole")), "doc_id")
    return rows.withColumn("text", piece("whole", F.col("start"), F.col("end"))).drop("whole")


def merge(candidates: DataFrame, ranges: DataFrame | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Findings: doc_id, id, start, end, text, type, confidence, sources, reason, normalized_value, tier, linked, link_group, linked_count.

    Rank them by doc_id, tier, start, end. A finding's offsets are the winner's; with the documents as ``whole`` they are those of
    all that overlaps it, so no part of a losing candidate stays uncovered.
    """
    return merged(candidates if ranges is None else suppressed(candidates, ranges), whole)


def merge_scan(rows: DataFrame) -> DataFrame:
    """The same for candidates and harmless ranges in one table, whose column ``harmless`` tells them apart; it is read once."""
    own = swept(rows, F.col("harmless"), "hidden")
    return merged(own.where("not harmless and not hidden").drop("harmless", "hidden"))


def merged(kept: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Findings of candidates that no range suppresses."""
    islands = clustered(kept)
    best = winners(islands) if whole is None else widened(winners(islands), islands, whole)
    found = best.join(facts(islands), ["doc_id", "island"]).drop("island").withColumn("id", F.concat(F.lit("m:"), F.col("start"), F.lit("-"), F.col("end")))
    found = linked(grouped(found))
    return found.select("doc_id", "id", "start", "end", "text", "type", "confidence", "sources", "reason", "normalized_value", tier("sources", F.col("linked_count") > 0).alias("tier"), "linked", "link_group", "linked_count")


def ranked(findings: DataFrame) -> DataFrame:
    """Findings in the order of review."""
    return findings.orderBy("doc_id", "tier", "start", "end")
