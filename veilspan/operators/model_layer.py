"""The language-model layer: overlapping text windows, a trigger gate, a client for replies, and re-anchoring.

Only the client's call leaves the JVM. Windows without a trigger word are filtered out before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contract import CONFIDENCE
from ..functions.matching import literal_places
from ..functions.scalars import mapped_type, model_sentence, piece, reason_or, unfenced
from .intervals import apart

# Window geometry, and the cue words.
WINDOW, OVERLAP, LONGEST_ENTITY = 800, 120, 80
TRIGGERS = (
    "supervisor manager colleague partner spouse wife husband mother father son daughter brother sister friend neighbour neighbor landlord tenant employer employee assistant secretary director officer contact referred introduced he she his her him "
    "doctor dr physician nurse patient diagnosed diagnosis prescribed treatment clinic hospital condition symptoms "
    "account salary payment invoice bank loan mortgage policy claim premium"
).split()
#: The cue words by their first letters, so that few alternatives are tried, and these only where a word can begin with one.
_FIRST = sorted({t[0] for t in TRIGGERS})
TRIGGER = rf"(?iuU)(?=[{''.join(_FIRST)}])\b(?:" + "|".join(f"{a}(?:{'|'.join(t[1:] for t in TRIGGERS if t[0] == a)})" for a in _FIRST) + r")\b"
FOUND_REASON = "relational/implicit PII the earlier layers missed"
SETTLED_REASON = "dictionary/NER disagreement resolved by the model"
DETECT_PROMPT = (
    "List personally identifying details in the passage that simple detectors miss, such as a person named only through a role or relationship. "
    'Copy each value exactly. Answer with JSON only: {"entities": [{"text": ..., "type": PERSON|ORG|EMAIL|PHONE|ADDRESS|ID_NUMBER|OTHER, "reason": ...}]}.'
)
SETTLE_PROMPT = 'Two detectors disagree whether the quoted span is sensitive. Answer with JSON only: {"is_pii": true|false, "type": PERSON|ORG|OTHER, "reason": ...}.'
ENTITY = "struct<text:string,type:string,reason:string>"


def text_windows(documents: DataFrame, size: int = WINDOW, overlap: int = OVERLAP, longest: int = LONGEST_ENTITY) -> DataFrame:
    """doc_id, w_start, chunk: overlapping windows; the last is the first that reaches the end; empty texts have none.

    The overlap must exceed the longest entity, so that each entity lies whole in some window.
    """
    if not longest < overlap < size:
        raise ValueError("the overlap must lie between the longest entity and the window")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step).cast("int"))
    rows = documents.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    return rows.select("doc_id", (F.col("k") * step).alias("w_start"), F.expr(f"substr(text, k * {step} + 1, {size})").alias("chunk"))


def gated(windows: DataFrame) -> DataFrame:
    """Windows with a trigger word."""
    return windows.where(F.col("chunk").rlike(TRIGGER))


def asked(windows: DataFrame, client) -> DataFrame:
    """Adds ``reply``. ``client`` has complete(system=..., user=...) -> str and is shipped to the workers.

    A failing call gives a null reply and its error's name in ``failure``, so that a layer can be reported as failed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, failures = [], []
            for chunk in batch["chunk"]:
                try:
                    replies.append(client.complete(system=DETECT_PROMPT, user=f"Find relational or implicit PII in this passage:\n\n{chunk}"))
                    failures.append(None)
                except Exception as error:  # noqa: BLE001
                    replies.append(None)
                    failures.append(type(error).__name__)
            yield batch.assign(reply=replies, failure=failures)

    return windows.mapInPandas(run, "doc_id long, w_start int, chunk string, reply string, failure string")


def parsed_entities(reply: Column | str) -> Column:
    """The entities of a reply: an object's ``entities`` or a bare list; anything else is an empty list."""
    bare = unfenced(reply)
    listed = F.when(bare.startswith("["), F.from_json(bare, f"array<{ENTITY}>")).otherwise(F.from_json(bare, f"struct<entities:array<{ENTITY}>>")["entities"])
    return F.filter(F.coalesce(listed, F.array().cast(f"array<{ENTITY}>")), lambda e: e.isNotNull() & e["text"].isNotNull())


def anchored(chunk: Column, entities: Column) -> Column:
    """Each value at its first place in the chunk that no value before it has claimed; values without one are dropped."""
    none = F.array().cast("array<struct<at:int,text:string,type:string,reason:string>>")

    def step(state: Column, e: Column) -> Column:
        free = F.filter(literal_places(chunk, e["text"]), lambda p: ~F.array_contains(state["claimed"], p))
        at = F.try_element_at(free, F.lit(1))
        hit = F.struct(at.alias("at"), e["text"].alias("text"), e["type"].alias("type"), e["reason"].alias("reason"))
        return F.when(at.isNull(), state).otherwise(F.struct(F.concat(state["claimed"], F.array(at)).alias("claimed"), F.concat(state["out"], F.array(hit)).alias("out")))

    return F.aggregate(entities, F.struct(F.array().cast("array<int>").alias("claimed"), none.alias("out")), step, lambda s: s["out"])


def model_hits(replies: DataFrame) -> DataFrame:
    """Hits of replies (doc_id, w_start, chunk, reply) at document offsets, the first of each range kept. A document with a ``failure`` has none."""
    failed = F.col("failure").isNotNull() if "failure" in replies.columns else F.lit(False)
    rows = replies.select("doc_id", "w_start", failed.alias("failed"), F.posexplode_outer(anchored(F.col("chunk"), parsed_entities("reply"))).alias("k", "e")).where("failed or e is not null")
    if "failure" in replies.columns:  # told by a window, so that replies are asked for once
        rows = rows.withColumn("failed", F.max("failed").over(Window.partitionBy("doc_id"))).where("not failed")
    rows = rows.select("doc_id", "w_start", "k", (F.col("w_start") + F.col("e.at")).alias("start"), (F.col("w_start") + F.col("e.at") + F.length("e.text")).alias("end"), F.col("e.text").alias("text"), mapped_type(F.coalesce("e.type", F.lit(""))).alias("type"), reason_or("e.reason", FOUND_REASON).alias("reason"))
    first = Window.partitionBy("doc_id", "start", "end").orderBy("w_start", "k")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "w_start", "k")


def detect_with_model(documents: DataFrame, client=None, covered: DataFrame | None = None, replies: DataFrame | None = None) -> DataFrame:
    """Candidates of the model layer. ``covered`` are earlier candidates; hits that overlap one are dropped.

    ``replies`` may be given instead of a client. If any window of a document failed, that document has no candidates.
    """
    if replies is None:
        replies = asked(gated(text_windows(documents)), client)
    hits = model_hits(replies)
    if covered is not None:
        hits = apart(hits, covered.select("doc_id", "start", "end"))
    return hits.select(
        "doc_id", (F.lit(3 << 40) + F.col("start").cast("long") * 65536 + (F.col("end") - F.col("start"))).alias("arrival"), F.concat(F.lit("llm:"), F.col("start"), F.lit("-"), F.col("end")).alias("id"), "start", "end", "text", "type",
        F.lit(CONFIDENCE["llm"]).alias("confidence"), F.lit("llm").alias("source"), "reason", F.lit(None).cast("string").alias("normalized_value"),
    )


def settle_disagreements(documents: DataFrame, disputed: DataFrame, client) -> DataFrame:
    """Spans among ``disputed`` (doc_id, start, end) that the model calls sensitive, at their offsets."""
    rows = disputed.select("doc_id", "start", "end").join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "start", "end", piece("text", F.col("start"), F.col("end")).alias("value"), model_sentence("text", F.col("start"), F.col("end")).alias("sentence"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(reply=[client.complete(system=SETTLE_PROMPT, user=f'Span: "{v}"\nSentence: "{s}"') for v, s in zip(batch["value"], batch["sentence"], strict=True)])

    replied = rows.mapInPandas(run, "doc_id long, start int, end int, value string, sentence string, reply string")
    verdict = F.from_json(unfenced("reply"), "struct<is_pii:boolean,type:string,reason:string>")
    out = replied.withColumn("v", verdict).where(F.coalesce(F.col("v.is_pii"), F.lit(False)))
    return out.select("doc_id", F.concat(F.lit("llm:"), F.col("start"), F.lit("-"), F.col("end")).alias("id"), "start", "end", F.col("value").alias("text"), mapped_type(F.coalesce("v.type", F.lit(""))).alias("type"), F.lit(CONFIDENCE["llm"]).alias("confidence"), F.lit("llm").alias("source"), reason_or("v.reason", SETTLED_REASON).alias("reason"))
