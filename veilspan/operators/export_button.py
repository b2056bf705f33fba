"""The export button as a table of transitions, and what it says in each state.

A first press exports, or arms the button if the answer is gated; only a second press on an armed button overrides the gate.
A change of the open high-risk items takes an armed button back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (phase, event) to phase; all other events leave a phase as it is. A press is told with its answer.
TRANSITIONS = {
    ("idle", "press_clean"): "done", ("idle", "press_gated"): "armed", ("armed", "confirm"): "done", ("armed", "cancel"): "idle", ("armed", "risk_changed"): "idle", ("done", "again"): "idle", ("done", "risk_changed"): "idle",
}


def event(kind: Column | str, gated: Column | str) -> Column:
    """A log's event, a press split by its answer."""
    own = F.col(kind) if isinstance(kind, str) else kind
    held = F.col(gated) if isinstance(gated, str) else gated
    return F.when(own == "press", F.when(F.coalesce(held, F.lit(False)), "press_gated").otherwise("press_clean")).otherwise(own)


def phase_after(events: Column) -> Column:
    """The phase after an array of events, from idle."""
    table = F.create_map(*[F.lit(x) for (phase, name), after in TRANSITIONS.items() for x in (f"{phase} {name}", after)])
    return F.aggregate(events, F.lit("idle"), lambda phase, e: F.coalesce(F.try_element_at(table, F.concat(phase, F.lit(" "), e)), phase))


def phases(log: DataFrame) -> DataFrame:
    """doc_id, phase after a log of (doc_id, seq, event, gated); null events change nothing."""
    own = log.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", event("event", "gated").alias("event")))).alias("events"))
    return own.select("doc_id", phase_after(F.filter(F.transform("events", lambda e: e["event"]), lambda e: e.isNotNull())).alias("phase"))


def label(phase: Column | str, open_items: Column | str) -> Column:
    """What the button says, with so many high-risk items open."""
    own = F.col(phase) if isinstance(phase, str) else phase
    n = F.col(open_items) if isinstance(open_items, str) else open_items
    return F.when(own == "done", "Exported").when(n == 0, "Export").when(own == "armed", "Export anyway").otherwise(F.concat(n.cast("string"), F.lit(" high-risk unresolved — review first")))
