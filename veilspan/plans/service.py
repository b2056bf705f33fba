"""The calls of the review service as functions over tables kept in a store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contract import OUTPUT_MODES, SpanError
from ..operators import review
from ..operators.render import legend, rendered
from ..operators.spans import require_disjoint, selected
from ..sources.stores import TableStore
from .detect import detect


class Service:
    """Sessions and reviews over batches of documents; a batch is a session of its own."""

    def __init__(self, spark: SparkSession, root: str, detector: str = "patterns"):
        self.spark, self.detector = spark, detector
        self.sessions, self.reviews = TableStore(spark, f"{root}/sessions"), TableStore(spark, f"{root}/reviews")

    def health(self) -> dict[str, str]:
        return {"status": "ok", "detector": self.detector}

    def init_session(self, documents: DataFrame, spans: DataFrame | None = None) -> str:
        """Keeps documents, and spans if there are any; the id of the session."""
        name = uuid.uuid4().hex
        self.sessions.put(name, documents=documents, **({} if spans is None else {"spans": spans}))
        return name

    def session(self, name: str) -> DataFrame:
        return self.sessions.get(name, "documents")

    def export(self, name: str, submitted: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
        """(text, legend) of the submitted (doc_id, ord, id) spans of a session."""
        _mode(mode)
        documents = self.session(name)
        if not self.sessions.has(name, "spans"):
            raise SpanError(400, "unknown_span_id", "the session has no spans")
        spans = selected(submitted, self.sessions.get(name, "spans"))
        require_disjoint(spans)
        return rendered(documents, spans, mode), legend(spans, mode)

    def create_review(self, documents: DataFrame, client=None) -> str:
        """Detects once and keeps documents, findings and the layers' report; all items are pending."""
        found, name = detect(documents, client=client), uuid.uuid4().hex
        self.reviews.put(name, documents=documents.select("doc_id", "text"), findings=found.findings.drop("linked"), layers=found.layers)
        return name

    def act(self, name: str, actions: DataFrame) -> DataFrame:
        """Appends actions to the log and returns the errors of the whole log."""
        documents, findings = self.reviews.get(name, "documents"), self.reviews.get(name, "findings")
        self.reviews.append(name, actions=actions)
        return review.action_errors(documents, findings, self.reviews.get(name, "actions"))

    def items(self, name: str) -> DataFrame:
        actions = self.reviews.get(name, "actions") if self.reviews.has(name, "actions") else None
        return review.queue(self.reviews.get(name, "documents"), self.reviews.get(name, "findings"), actions)

    def state(self, name: str, mode: str = "REDACT") -> DataFrame:
        _mode(mode)
        return review.state(self.reviews.get(name, "documents"), self.items(name), self.reviews.get(name, "layers"), mode)

    def preview(self, name: str, mode: str) -> tuple[DataFrame, DataFrame]:
        _mode(mode)
        return review.preview(self.reviews.get(name, "documents"), self.items(name), mode)

    def export_review(self, name: str, mode: str, confirm: bool = False) -> DataFrame:
        _mode(mode)
        return review.export(self.reviews.get(name, "documents"), self.items(name), mode, confirm)


def as_json(frame: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return frame.select(F.to_json(F.struct(*frame.columns)).alias("json"))


def _mode(mode: str) -> None:
    if mode not in OUTPUT_MODES:
        raise ValueError(f"unknown output mode {mode!r}")
