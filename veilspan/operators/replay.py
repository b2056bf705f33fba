"""A document's review log, replayed one action at a time: which actions fail, and which an undo takes back.

A decision on an item that was added by hand holds only while the item is there, and that depends on the actions and
undos before it, some of them such decisions again. So a log is read in its order, with what stands and what was
added as state. Rows stream through sorted by document and seq; time is linear in the log, memory that of one log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: Rows that are gathered before a batch is sent on, at the end of a document.
BATCH_ROWS = 5_000


class Replay:
    """What stands after the actions so far: ``standing``, the last one first to be undone, and the ``added`` items."""

    def __init__(self):
        self.standing: list[tuple[object, str | None]] = []
        self.added: set[str] = set()

    def take(self, place: object, kind: str, item: str | None, open_: bool, fault: str | None) -> tuple[str | None, object]:
        """(fault, place of the action that an undo takes back). ``open_`` marks a decision that needs an added item."""
        if fault is not None:
            return fault, None
        if kind == "undo":
            if not self.standing:
                return "nothing_to_undo", None
            undone, added = self.standing.pop()
            self.added.discard(added)
            return None, undone
        if open_ and item not in self.added:
            return "unknown_item", None
        if kind == "add_missed":
            self.added.add(item)
        self.standing.append((place, item if kind == "add_missed" else None))
        return None, None


def replayed(log: DataFrame) -> DataFrame:
    """``log`` (doc_id, seq, type, item, open, fault and more) with ``fault`` settled, and ``undone``: the seq of the undo that took an action back."""
    names = log.columns
    at = [names.index(c) for c in ("doc_id", "seq", "type", "item", "open", "fault")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        faults: list[str | None] = []
        undone: list[int | None] = []

        def sent() -> Iterator[pa.RecordBatch]:
            low = 0
            for part in held:
                high = low + part.num_rows
                columns = [pa.array(faults[low:high], pa.string()) if k == at[5] else part.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(undone[low:high], pa.int64())], names=[*names, "undone"])
                low = high
            for x in (held, faults, undone):
                x.clear()

        doc, replay = None, None
        for batch in batches:
            low = 0
            for k, (d, seq, kind, item, open_, fault) in enumerate(zip(*(batch.column(j).to_pylist() for j in at), strict=True)):
                if replay is None or d != doc:
                    if len(faults) >= BATCH_ROWS:
                        held.append(batch.slice(low, k - low))
                        yield from sent()
                        low = k
                    doc, replay = d, Replay()
                fault, back = replay.take(len(faults), kind, item, open_, fault)
                faults.append(fault)
                undone.append(None)
                if back is not None:
                    undone[back] = seq
            held.append(batch.slice(low))
        yield from sent()

    schema = StructType([StructField(f.name, f.dataType) for f in log.schema] + [StructField("undone", LongType())])
    return log.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(run, schema)
