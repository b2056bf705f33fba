"""Detection over streams of documents, and reviews whose log arrives as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.patterns import detect_patterns


def pattern_stream(documents: DataFrame) -> DataFrame:
    """Candidates of the pattern layer for a streaming table; the layer has no state, so output follows input."""
    return detect_patterns(documents)


def windowed_counts(candidates: DataFrame, time: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Candidates by event-time window and type; rows later than ``late`` are left out."""
    return candidates.withWatermark(time, late).groupBy(F.window(time, size).alias("window"), "type").agg(F.count("*").alias("n"))


def decision_stream(actions: DataFrame) -> DataFrame:
    """The latest status of each item, from a stream of accept, dismiss and undo actions (doc_id, seq, type, target_id).

    A document's state is its stack of (item, status before); an undo pops it. Rows of a micro-batch are taken by seq.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, befores = state.get if state.exists else ([], [])
        status = {}
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        stack = list(zip(items, befores, strict=True))
        current = _current(stack)
        for kind, target in zip(rows["type"], rows["target_id"], strict=True):
            if kind in ("accept", "dismiss") and target:
                word = "accepted" if kind == "accept" else "dismissed"
                stack.append((target, word))
                current[target] = status[target] = word
            elif kind == "undo" and stack:
                target, _ = stack.pop()
                current = _current(stack)
                status[target] = current.get(target, "pending")
        state.update(([t for t, _ in stack], [w for _, w in stack]))
        yield pd.DataFrame({"doc_id": [key[0]] * len(status), "target_id": list(status), "status": list(status.values())})

    return actions.groupBy("doc_id").applyInPandasWithState(run, "doc_id long, target_id string, status string", "items array<string>, words array<string>", "update", GroupStateTimeout.NoTimeout)


def _current(stack: list[tuple[str, str]]) -> dict[str, str]:
    return dict(stack)
