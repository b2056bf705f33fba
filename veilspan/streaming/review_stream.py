"""Reviews whose log arrives as a stream, with the whole meaning of a log: links, additions, undos and faults.

Faults that don't depend on other actions, and what a decision reaches, are found by joins with the tables of documents and
findings. A document's state is what stands of its log; each micro-batch takes its actions in the order of ``seq``, and tells what
has changed. An action that comes after one of a higher ``seq`` in an earlier batch is taken when it comes.

The state needs a store with columns: set ``spark.sql.streaming.stateStore.providerClass`` to ``ROCKS_DB``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.merge import with_groups
from ..operators.replay import Replay
from ..operators.review import _checked

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What stands: a decision with what it reaches, or an addition with the finding at its place. ``there``: the item wasn't taken away.
STANDING = "seq long, type string, item string, link_group string, place_id string, there boolean, start int, end int, pii_type string"
#: What changed: a finding or added item (scope item), a group of findings (group), or an action that failed (error).
CHANGES = "doc_id long, seq long, scope string, key string, status string, start int, end int, pii_type string"
COLUMNS = [x.split()[0] for x in STANDING.split(", ")]
WORDS = {"accept": "accepted", "dismiss": "dismissed"}


class _Log(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("standing", STANDING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        standing = [dict(zip(COLUMNS, r, strict=True)) for r in self.kept.get()]
        replay = Replay()
        replay.standing = [(k, a["item"] if a["type"] == "add_missed" else None) for k, a in enumerate(standing)]
        replay.added = {a["item"] for a in standing if a["there"]}
        log = pd.concat(list(rows)).sort_values("seq", kind="stable")
        changed: dict[tuple[str, str], None] = {}
        out, last = [], 0
        for action in log.astype(object).where(log.notna(), None).to_dict("records"):
            last = int(action["seq"])
            fault, undone = replay.take(len(standing), action["type"], action["item"], bool(action["open"]), action["fault"])
            if fault:
                out.append((last, "error", str(last), fault, None, None, None))
                continue
            if action["type"] == "undo":
                action = standing.pop(undone)
                if action["type"] == "add_missed":
                    for a in standing:
                        a["there"] = a["there"] and a["item"] != action["item"]
            else:
                standing.append({c: action[c] for c in COLUMNS if c != "there"} | {"there": action["type"] == "add_missed"})
            decides = action["type"] in WORDS
            changed["group" if decides and action["link_group"] else "item", action["link_group"] if decides and action["link_group"] else action["item"]] = None
        groups = {k for scope, k in changed if scope == "group"}
        for a in standing:  # added items that a group's decisions reach
            if a["there"] and a["link_group"] in groups:
                changed["item", a["item"]] = None
        out += [(last, scope, k, *_status(standing, scope, k)) for scope, k in changed]
        # Numbers of numpy's aren't taken for a state's.
        self.kept.put([tuple(int(v) if c in ("seq", "start", "end") and v is not None else v for c, v in a.items()) for a in ({c: a[c] for c in COLUMNS} for a in standing)]) if standing else self.kept.clear()
        made = pd.DataFrame([(key[0], *row) for row in out], columns=[x.split()[0] for x in CHANGES.split(", ")])
        yield made.astype({"start": "Int32", "end": "Int32"})

    def close(self) -> None:
        pass


def _status(standing: list[dict], scope: str, key: str) -> tuple[str, int | None, int | None, str | None]:
    """(status, start, end, type) of a group, a finding or an added item; ``gone`` for an added item that was taken away."""
    decided = [a for a in standing if a["type"] in WORDS]
    if scope == "group":
        return next((WORDS[a["type"]] for a in reversed(decided) if a["link_group"] == key), "pending"), None, None, None
    added = next((a for a in reversed(standing) if a["there"] and a["item"] == key), None)
    if added is None:
        own = next((WORDS[a["type"]] for a in reversed(decided) if a["item"] == key), None)
        return (own or "pending") if not key.startswith("manual:") else "gone", None, None, None
    reached = (a for a in reversed(decided) if a["seq"] > added["seq"] and (a["item"] == key or (a["link_group"] is not None and a["link_group"] == added["link_group"] and a["item"] != added["place_id"])))
    return WORDS[next(reached, {"type": "accept"})["type"]], added["start"], added["end"], added["pii_type"] or "OTHER"


def review_stream(documents: DataFrame, findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Changes (``CHANGES``) of a stream of actions (doc_id, seq, type, target_id, start, end, pii_type), for update mode."""
    own = with_groups(findings)
    checked = _checked(documents, own, actions)
    places = own.where("link_group is not null").select("doc_id", "start", "end", F.col("id").alias("place_id"), F.col("link_group").alias("place_group"))
    located = checked.join(places, ["doc_id", "start", "end"], "left")
    located = located.withColumn("link_group", F.when(F.col("type") == "add_missed", F.col("place_group")).otherwise(F.col("link_group"))).drop("place_group")
    return located.groupBy("doc_id").transformWithStateInPandas(_Log(), CHANGES, "Update", "None")


def statuses(changes: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, id, status of all items, from the changes of a stream so far."""
    own = with_groups(findings)
    newest = Window.partitionBy("doc_id", "scope", "key").orderBy(F.desc("seq"))
    last = changes.where("scope <> 'error'").withColumn("n", F.row_number().over(newest)).where("n = 1")
    groups = last.where("scope = 'group'").select("doc_id", F.col("key").alias("link_group"), F.col("status").alias("by_group"))
    items = last.where("scope = 'item' and not startswith(key, 'manual:')").select("doc_id", F.col("key").alias("id"), F.col("status").alias("own"))
    found = own.select("doc_id", "id", "link_group").join(items, ["doc_id", "id"], "left").join(groups, ["doc_id", "link_group"], "left")
    added = last.where("scope = 'item' and startswith(key, 'manual:') and status <> 'gone'").select("doc_id", F.col("key").alias("id"), "status")
    return found.select("doc_id", "id", F.coalesce("by_group", "own", F.lit("pending")).alias("status")).unionByName(added)
