"""Review: a queue of findings, an undoable log of decisions, counters, preview and gated export.

A review is a pair of tables: findings, and a log of actions numbered by ``seq`` in each document. Joins tell what an
action is about and which faults don't depend on other actions; one pass over each log in its order settles the rest.
Of what stands, the last decision on an item counts; decisions on findings that link count for their group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import MANUAL_REASON, PII_TYPES
from ..functions.scalars import sentence
from .merge import with_groups
from .render import legend, rendered
from .replay import replayed

ITEM = "id string, start int, end int, text string, type string, confidence double, sources array<string>, reason string, normalized_value string, tier int, linked array<struct<start:int,end:int>>"


def _checked(documents: DataFrame, findings: DataFrame, actions: DataFrame) -> DataFrame:
    """The log of the known documents with ``item``, the id that an action is about, its ``link_group``, and ``fault``, the code of
    an error that doesn't depend on the actions before it. Decisions on added items are ``open``: they need the item to be there."""
    sizes = documents.select("doc_id", F.length("text").alias("length"))
    known = findings.select("doc_id", F.col("id").alias("target_id"), "link_group", F.lit(True).alias("known"))
    log = actions.join(sizes, "doc_id").join(known, ["doc_id", "target_id"], "left")
    decides, adds = F.col("type").isin("accept", "dismiss"), F.col("type") == "add_missed"
    added = F.col("target_id").rlike("^manual:[0-9]+-[0-9]+$")
    inside = (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("length"))
    fault = (
        F.when(decides & F.col("known").isNull() & ~F.coalesce(added, F.lit(False)), "unknown_item")
        .when(adds & (F.col("start").isNull() | F.col("end").isNull()), "missing_selection")
        .when(adds & ~inside, "span_offsets_out_of_range")
        .when(~F.coalesce(decides | adds | (F.col("type") == "undo"), F.lit(False)), "unknown_action")
    )
    item = F.when(adds, F.concat(F.lit("manual:"), "start", F.lit("-"), "end")).when(decides, F.col("target_id"))
    log = log.withColumn("fault", fault).withColumn("item", item).withColumn("open", F.coalesce(decides & F.col("known").isNull() & F.col("fault").isNull(), F.lit(False)))
    return log.select("doc_id", F.col("seq").cast("long").alias("seq"), "type", "item", "start", "end", "pii_type", "link_group", "open", "fault")


def settled(documents: DataFrame, findings: DataFrame, actions: DataFrame) -> DataFrame:
    """The log with every action's ``fault`` and ``undone``, the seq of the undo that takes it back."""
    return replayed(_checked(documents, with_groups(findings), actions))


def _comings(paired: DataFrame) -> DataFrame:
    """When added items come and go: doc_id, item, seq, there, start, end, pii_type. An undone addition takes its item away."""
    added = paired.where("type = 'add_missed' and fault is null")
    both = F.array(F.struct("seq", F.lit(True).alias("there")), F.struct(F.col("undone").alias("seq"), F.lit(False).alias("there")))
    return added.select("doc_id", "item", F.explode(both).alias("x"), "start", "end", "pii_type").select("doc_id", "item", "x.seq", "x.there", "start", "end", "pii_type").where("seq is not null")


def _after(documents: DataFrame, findings: DataFrame, actions: DataFrame) -> DataFrame:
    """What a log leaves: rows of decided findings (doc_id, id, status) and of added items (with start, end, type too).

    A decision on a finding reaches the findings of its group, and items added at the places of the others of it.
    """
    paired = settled(documents, findings, actions)
    decided = paired.where("type in ('accept', 'dismiss') and fault is null and undone is null")
    status = F.when(F.col("type") == "accept", "accepted").otherwise("dismissed")
    last = decided.groupBy("doc_id", "item").agg(F.max("seq").alias("seq"), F.max_by(status, "seq").alias("status"), F.first("link_group").alias("link_group"))
    newest = F.row_number().over(Window.partitionBy("doc_id", "link_group").orderBy(F.desc("seq")))
    # The two items of a group that were decided last: of the places that aren't an item's own, one of them was decided last.
    groups = last.where("link_group is not null").withColumn("n", newest).where("n <= 2").groupBy("doc_id", "link_group").agg(F.array_sort(F.collect_list(F.struct("n", "item", "seq", "status"))).alias("newest"))
    own = last.where("link_group is null").select("doc_id", F.col("item").alias("id"), "seq", "status")
    linked = findings.where("link_group is not null").select("doc_id", "id", "start", "end", "link_group").join(groups, ["doc_id", "link_group"])
    there = _comings(paired).groupBy("doc_id", F.col("item").alias("id")).agg(F.max_by(F.struct("there", "start", "end", "pii_type", "seq"), "seq").alias("x")).where("x.there")
    added = there.select("doc_id", "id", "x.start", "x.end", F.coalesce("x.pii_type", F.lit("OTHER")).alias("type"), F.col("x.seq").alias("since"))
    at_place = linked.select("doc_id", "start", "end", F.get(F.filter("newest", lambda d: d["item"] != F.col("id")), F.lit(0)).alias("by_group"))
    later = added.join(own.withColumnsRenamed({"seq": "own_seq", "status": "own_status"}), ["doc_id", "id"], "left").join(at_place, ["doc_id", "start", "end"], "left")
    candidates = F.array(F.struct(F.col("since").alias("seq"), F.lit("accepted").alias("status")), F.struct(F.col("own_seq").alias("seq"), F.col("own_status").alias("status")), F.struct("by_group.seq", "by_group.status"))
    manual = later.select("doc_id", "id", "start", "end", "type", F.array_max(F.filter(candidates, lambda c: c["seq"].isNotNull()))["status"].alias("status"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("end", "int"), ("type", "string"))]
    found = own.select("doc_id", "id", *none, "status").unionByName(linked.select("doc_id", "id", *none, F.col("newest")[0]["status"].alias("status")))
    return found.withColumn("manual", F.lit(False)).unionByName(manual.withColumn("manual", F.lit(True)))


def queue(documents: DataFrame, findings: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """All items with their status after the log, and their sentence: the columns of findings, status, linked_count, sentence.

    Findings without a ``linked_count`` get one from their ``linked`` places.
    """
    texts = documents.select("doc_id", F.col("text").alias("whole"))
    grouped = with_groups(findings)
    if actions is None:
        rows = grouped.withColumn("status", F.lit("pending"))
    else:
        after = _after(documents, grouped, actions)
        seen = grouped.join(after.where("not manual").select("doc_id", "id", "status"), ["doc_id", "id"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))
        manual = after.where("manual").select("doc_id", "id", "start", "end", "type", "status")
        added = manual.join(texts, "doc_id").select("doc_id", "id", "start", "end", F.expr("substr(whole, start + 1, end - start)").alias("text"), "type", F.lit(1.0).alias("confidence"), F.array(F.lit("manual")).alias("sources"), F.lit(MANUAL_REASON).alias("reason"), F.lit(None).cast("string").alias("normalized_value"), F.lit(1).alias("tier"), F.lit(None).cast("string").alias("link_group"), F.lit(0).cast("long").alias("linked_count"), "status")
        if "linked" in grouped.columns:
            added = added.withColumn("linked", F.array().cast("array<struct<start:int,end:int>>"))
        rows = seen.unionByName(added)
    return rows.join(texts, "doc_id").withColumn("sentence", sentence("whole", F.col("start"), F.col("end"))).drop("whole")


def action_errors(documents: DataFrame, findings: DataFrame, actions: DataFrame) -> DataFrame:
    """doc_id, seq, error for the actions that failed: unknown_action, unknown_item, missing_selection, span_offsets_out_of_range, nothing_to_undo."""
    return settled(documents, findings, actions).where("fault is not null").select("doc_id", "seq", F.col("fault").alias("error"))


def ordered(items: DataFrame) -> DataFrame:
    """Items with their 1-based place in the queue: by tier, then start."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("tier", "start", "end")))


def jump_targets(items: DataFrame, keys: int = 9) -> DataFrame:
    """The items that the number keys reach."""
    return ordered(items).where(F.col("place") <= keys)


def recent_actions(actions: DataFrame, limit: int = 50) -> DataFrame:
    """Each document's newest actions first, at most ``limit``."""
    return actions.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("seq")))).where(F.col("place") <= limit)


def by_tier(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, tier, items: all three tiers of every document, empty ones too."""
    tiers = documents.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("tier"))
    lists = ordered(items).groupBy("doc_id", "tier").agg(F.array_sort(F.collect_list(F.struct("place", "id", "status"))).alias("items"))
    return tiers.join(lists, ["doc_id", "tier"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<place:int,id:string,status:string>>")))


def counts(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The seven counters of every document."""
    made = items.groupBy("doc_id").agg(
        *[F.count_if(F.col("tier") == k).alias(f"tier{k}") for k in (1, 2, 3)],
        *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "dismissed", "pending")],
        F.count_if((F.col("tier") == 1) & (F.col("status") == "pending")).alias("unresolved_high_risk"),
    )
    names = ["tier1", "tier2", "tier3", "accepted", "dismissed", "pending", "unresolved_high_risk"]
    return documents.select("doc_id").join(made, "doc_id", "left").select("doc_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def flip(items: DataFrame, doc_id: int, target: str, seq: int) -> DataFrame:
    """The action that toggles an item: a dismissed one is accepted, any other dismissed."""
    row = items.where((F.col("doc_id") == doc_id) & (F.col("id") == target))
    return row.select("doc_id", F.lit(seq).cast("long").alias("seq"), F.when(F.col("status") == "dismissed", "accept").otherwise("dismiss").alias("type"), F.col("id").alias("target_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("pii_type"))


def accepted(items: DataFrame) -> DataFrame:
    """Accepted items as spans; the source is the first of the sorted sources, else manual."""
    return items.where("status = 'accepted'").withColumn("source", F.coalesce(F.try_element_at("sources", F.lit(1)), F.lit("manual")))


def preview(documents: DataFrame, items: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(text, legend) of the accepted items, from findings as they are; nothing is detected anew."""
    own = accepted(items)
    return rendered(documents, own, mode), legend(own, mode)


def export(documents: DataFrame, items: DataFrame, mode: str, confirm: bool = False) -> DataFrame:
    """doc_id, gated, output_text, legend, unresolved, error.

    Where items of tier 1 are pending and ``confirm`` is false, the document is gated: no text and no legend, only
    what still needs review.
    """
    open_ = items.where("tier = 1 and status = 'pending'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "id"))).alias("unresolved"))
    text, entries = preview(documents, items, mode)
    entries = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "token", "type", "occurrences"))).alias("legend"))
    rows = text.join(entries, "doc_id", "left").join(open_, "doc_id", "left")
    gated = F.col("unresolved").isNotNull() & F.lit(not confirm)
    return rows.select("doc_id", gated.alias("gated"), F.when(~gated, F.col("output_text")).alias("output_text"), F.when(~gated, F.coalesce("legend", F.array().cast("array<struct<ord:int,token:string,type:string,occurrences:bigint>>"))).alias("legend"), F.when(gated, F.col("unresolved")).alias("unresolved"), F.when(~gated, F.col("error")).alias("error"))


def state(documents: DataFrame, items: DataFrame, layers: DataFrame, mode: str) -> DataFrame:
    """One nested row for each document: text, mode, layers, queue and counters."""
    lists = ordered(items).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "start", "end", "text", "type", "tier", "status", "sentence", "linked_count"))).alias("queue"))
    own = counts(documents, items)
    own = own.select("doc_id", F.struct(*[c for c in own.columns if c != "doc_id"]).alias("counts"))
    ran = layers.groupBy("doc_id").agg(F.collect_list(F.struct("name", "status", "count", "detail")).alias("layers"))
    return documents.select("doc_id", "text", F.lit(mode).alias("output_mode")).join(ran, "doc_id", "left").join(lists, "doc_id", "left").join(own, "doc_id")


def action_rows(spark, rows: Sequence[tuple]) -> DataFrame:
    """A log from (doc_id, seq, type, target_id, start, end, pii_type) rows."""
    if any(r[6] is not None and r[6] not in PII_TYPES for r in rows):
        raise ValueError("an action has an unknown type of data")
    return spark.createDataFrame(list(rows), "doc_id long, seq long, type string, target_id string, start int, end int, pii_type string")
