import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions import scalars
from veilspan.functions.contract import SpanError, error_envelope
from veilspan.operators import consistency, merge, render, review, spans
from veilspan.plans.service import Service, as_json

SPAN = "doc_id long, arrival long, start int, end int, text string, type string, confidence double, source string, reason string, normalized_value string"
TEXT = "0123456789" * 8


def candidates(spark, rows):
    return spark.createDataFrame([(d, k, s, e, TEXT[s:e], t, c, src, why, n) for k, (d, s, e, t, c, src, why, n) in enumerate(rows)], SPAN)


def merged(spark, rows, ranges=()):
    allowed = spark.createDataFrame(list(ranges), "doc_id long, start int, end int") if ranges else None
    return {(r["doc_id"], r["start"], r["end"]): r for r in merge.merge(candidates(spark, rows), allowed).collect()}


def test_clusters_are_transitive_and_touching_spans_stay_apart(spark):
    got = merged(spark, [(1, 0, 5, "PERSON", 0.8, "ner", "a", None), (1, 4, 9, "EMAIL", 0.99, "regex", "b", ""), (1, 8, 20, "ORG", 0.55, "llm", "c", "v"), (1, 20, 25, "ORG", 0.7, "ner", "d", None), (2, 3, 6, "ORG", 0.7, "ner", "d", None)])
    assert set(got) == {(1, 4, 9), (1, 20, 25), (2, 3, 6)}
    r = got[1, 4, 9]
    assert (r["type"], r["confidence"], r["sources"], r["reason"], r["normalized_value"], r["tier"], r["id"]) == ("EMAIL", 0.99, ["llm", "ner", "regex"], "[ner] a | [regex] b | [llm] c", "v", 1, "m:4-9")
    assert got[1, 20, 25]["tier"] == 2


def test_winners_by_class_then_confidence_then_place(spark):
    assert set(merged(spark, [(1, 0, 9, "A", 0.85, "ner", "", None), (1, 2, 5, "B", 0.55, "llm", "", None)])) == {(1, 2, 5)}
    assert set(merged(spark, [(1, 0, 5, "A", 0.98, "dictionary", "", None), (1, 0, 7, "B", 0.99, "regex", "", None)])) == {(1, 0, 7)}
    assert set(merged(spark, [(1, 0, 7, "A", 0.7, "ner", "", None), (1, 0, 5, "B", 0.7, "ner", "", None)])) == {(1, 0, 5)}
    assert next(iter(merged(spark, [(1, 0, 5, "A", 0.55, "llm", "", None)]).values()))["tier"] == 3


def test_suppression_is_by_overlap(spark):
    rows = [(1, 0, 6, "ORG", 0.99, "regex", "", None), (1, 10, 12, "ORG", 0.99, "regex", "", None), (2, 0, 6, "ORG", 0.99, "regex", "", None)]
    assert set(merged(spark, rows, [(1, 5, 10)])) == {(1, 10, 12), (2, 0, 6)}


def test_phones_link_within_a_document_only(spark):
    got = merged(spark, [(1, 0, 5, "PHONE", 0.99, "regex", "", "0413552760"), (1, 10, 15, "PHONE", 0.99, "regex", "", "61413552760"), (2, 0, 5, "PHONE", 0.99, "regex", "", "0413552760"), (1, 20, 22, "PERSON", 0.8, "ner", "", None), (1, 30, 32, "PERSON", 0.8, "ner", "", None)])
    assert [tuple(o) for o in got[1, 0, 5]["linked"]] == [(10, 15)] and got[2, 0, 5]["linked"] == [] and got[1, 20, 22]["linked"] == []


def accepted(spark, rows):
    return spark.createDataFrame([(d, s, e, t, k, n) for d, s, e, t, k, n in rows], "doc_id long, start int, end int, text string, type string, normalized_value string")


def test_render_and_legend(spark):
    text = "Ann \U0001f600 called 0413 552 760, +61 413 552 760 and ann. Bob too."
    at = lambda v, k=0: (text.index(v, k), text.index(v, k) + len(v), v)
    own = accepted(spark, [(1, *at("Ann"), "PERSON", None), (1, *at("0413 552 760"), "PHONE", "0413552760"), (1, *at("+61 413 552 760"), "PHONE", "61413552760"), (1, *at("ann"), "PERSON", None), (1, *at("Bob"), "PERSON", None)])
    docs = spark.createDataFrame([(1, text), (2, "untouched")], "doc_id long, text string")
    out = {r["doc_id"]: r["output_text"] for r in render.rendered(docs, own, "ANONYMIZE").collect()}
    assert out == {1: "[PERSON_1] \U0001f600 called [PHONE_1], [PHONE_1] and [PERSON_1]. [PERSON_2] too.", 2: "untouched"}
    legend = [tuple(r) for r in render.legend(own, "ANONYMIZE").orderBy("ord").collect()]
    assert legend == [(1, "[PERSON_1]", "PERSON", 2, 1), (1, "[PHONE_1]", "PHONE", 2, 2), (1, "[PERSON_2]", "PERSON", 1, 3)]
    assert render.rendered(docs, own, "REDACT").where("doc_id = 1").first()["output_text"] == "[REDACTED] \U0001f600 called [REDACTED], [REDACTED] and [REDACTED]. [REDACTED] too."
    assert {r["token"] for r in render.legend(own, "REDACT").collect()} == {"[REDACTED]"}


def test_overlapping_accepted_spans_are_an_error(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, TEXT)], "doc_id long, text string")
    own = accepted(spark, [(1, 48, 65, "x", "ORG", None), (1, 56, 70, "y", "ORG", None), (2, 0, 4, "x", "ORG", None), (2, 4, 6, "y", "ORG", None)])
    out = {r["doc_id"]: (r["output_text"] is None, r["error"]) for r in render.rendered(docs, own, "REDACT").collect()}
    assert out == {1: (True, "overlapping_accepted_spans"), 2: (False, None)}
    with pytest.raises(SpanError) as e:
        spans.require_disjoint(own)
    assert e.value.status == 400 and error_envelope(e.value)[1]["error"] == "overlapping_accepted_spans"
    assert error_envelope(ValueError("x"))[0] == 422 and error_envelope(OSError("x"))[0] == 500


def test_unsound_spans_raise_when_read(spark):
    docs = spark.createDataFrame([(1, "a\U0001f600b")], "doc_id long, text string")
    claim = lambda s, e, t: spark.createDataFrame([(1, s, e, t)], "doc_id long, start int, end int, text string")
    assert spans.sound(claim(1, 3, None), docs).first()["text"] == "\U0001f600b"
    assert spans.sound(claim(2, 2, ""), docs).first()["text"] == ""
    for bad in ((1, 4, None), (-1, 2, None), (2, 1, None), (0, 1, "b")):
        with pytest.raises(Exception, match="span_offset"):
            spans.sound(claim(*bad), docs).collect()


FINDING = "doc_id long, id string, start int, end int, text string, type string, confidence double, sources array<string>, reason string, normalized_value string, tier int, linked array<struct<start:int,end:int>>"
LINKED = {"m:0-1": [(2, 3)], "m:2-3": [(0, 1)], "m:4-5": []}


def findings_of(spark, ids):
    return spark.createDataFrame([(d, k, *map(int, k[2:].split("-")), "x", "ORG", 0.9, ["ner"], "", None, 2, LINKED[k]) for d in ids for k in LINKED], FINDING)


def plain_state(log):
    """What stands after a log, found anew for every prefix from the actions that are still standing: statuses and errors."""
    standing, errors, gone = [], [], []  # gone: (seq of the undo, name) of additions taken back

    def state(at):
        status = dict.fromkeys(LINKED, "pending")
        events = sorted([(a[0], "add", a) for a in standing if a[1] == "add_missed"] + [(s, "go", name) for s, name in gone] + [(a[0], "set", a) for a in standing if a[1] != "add_missed"])
        # A later addition of the same place stands for the earlier one, until either is taken back.
        for _, kind, a in events:
            if kind == "add":
                status[f"manual:{a[3]}-{a[4]}"] = "accepted"
            elif kind == "go":
                status.pop(a, None)
            else:
                places = {f"{p}:{s}-{e}" for s, e in LINKED.get(a[2], []) for p in ("m", "manual")} | {a[2]}
                status.update({k: "accepted" if a[1] == "accept" else "dismissed" for k in status if k in places})
        return status

    for a in log:
        seq, kind, target, start, end = a[:5]
        error = None
        if kind in ("accept", "dismiss"):
            error = None if target in state(seq) else "unknown_item"
        elif kind == "add_missed":
            error = "missing_selection" if start is None or end is None else None if 0 <= start <= end <= 80 else "span_offsets_out_of_range"
        elif kind == "undo":
            error = None if standing else "nothing_to_undo"
        else:
            error = "unknown_action"
        if error:
            errors.append((seq, error))
        elif kind == "undo":
            last = standing.pop()
            if last[1] == "add_missed":
                gone.append((seq, f"manual:{last[3]}-{last[4]}"))
        else:
            standing.append(a)
    return state(None), sorted(errors)


def test_logs_leave_what_a_plain_replay_leaves(spark):
    rng = random.Random(5)
    logs = {}
    for d in range(150):
        kinds = rng.choice([["accept", "dismiss", "add_missed", "undo", "undo"], ["accept", "dismiss", "undo"], ["accept", "dismiss", "add_missed", "undo", "fly"]])
        made = []
        for seq in range(rng.randint(0, 14)):
            s = rng.choice([0, 2, 6, 7, 79, None])
            target = rng.choice([*LINKED, "m:9-9", "manual:6-8", "manual:0-1", "manual:2-3", None])
            made.append((seq, rng.choice(kinds), target, s, None if s is None else s + rng.choice([1, 2]), None))
        logs[d] = made
    rows = [(d, *a[:5], a[5]) for d, made in logs.items() for a in made]
    log = review.action_rows(spark, [(d, seq, k, t, s, e, p) for d, seq, k, t, s, e, p in rows])
    docs = spark.createDataFrame([(d, TEXT) for d in logs], "doc_id long, text string")
    found = findings_of(spark, logs)
    got, errors = {d: {} for d in logs}, {d: [] for d in logs}
    for r in review.queue(docs, found, log).collect():
        got[r["doc_id"]][r["id"]] = r["status"]
    for r in review.action_errors(docs, found, log).collect():
        errors[r["doc_id"]].append((r["seq"], r["error"]))
    for d, made in logs.items():
        assert (got[d], sorted(errors[d])) == plain_state(made), made


def test_cascade_and_repeated_additions(spark):
    docs = spark.createDataFrame([(d, TEXT) for d in (1, 2, 3)], "doc_id long, text string")
    log = review.action_rows(spark, [
        (1, 1, "accept", "m:2-3", None, None, None), (2, 1, "accept", "m:2-3", None, None, None), (2, 2, "undo", None, None, None, None),
        (3, 1, "add_missed", None, 5, 7, None), (3, 2, "add_missed", None, 5, 7, "ORG"), (3, 3, "undo", None, None, None, None), (3, 4, "add_missed", None, 5, 81, None), (3, 5, "accept", "manual:5-7", None, None, None), (3, 6, "accept", None, None, None, None), (3, 7, "add_missed", None, None, 1, None), (3, 8, "other", None, None, None, None),
    ])
    got = {(r["doc_id"], r["id"]): r["status"] for r in review.queue(docs, findings_of(spark, (1, 2, 3)), log).collect()}
    assert got[1, "m:0-1"] == got[1, "m:2-3"] == "accepted" and got[1, "m:4-5"] == "pending"
    assert got[2, "m:0-1"] == got[2, "m:2-3"] == "pending" and (3, "manual:5-7") not in got  # one undo takes it away
    errors = [tuple(r)[1:] for r in review.action_errors(docs, findings_of(spark, (1, 2, 3)), log).orderBy("seq").collect()]
    assert errors == [(4, "span_offsets_out_of_range"), (5, "unknown_item"), (6, "unknown_item"), (7, "missing_selection"), (8, "unknown_action")]


def test_service(spark, tmp_path):
    service = Service(spark, f"file://{tmp_path}/store")
    docs = spark.createDataFrame([(1, "Call 0413 552 760 or +61 413 552 760. Bye."), (2, "none")], "doc_id long, text string")
    name = service.create_review(docs)
    items = review.ordered(service.items(name)).collect()
    assert [(r["status"], r["tier"], r["linked_count"], r["sentence"]) for r in items] == [("pending", 1, 1, "Call 0413 552 760 or +61 413 552 760")] * 2
    gated = {r["doc_id"]: r for r in service.export_review(name, "REDACT").collect()}
    assert gated[1]["gated"] and gated[1]["output_text"] is None and len(gated[1]["unresolved"]) == 2 and not gated[2]["gated"] and gated[2]["output_text"] == "none"
    assert service.export_review(name, "REDACT", confirm=True).where("doc_id = 1").first()["output_text"].startswith("Call 0413")
    assert service.act(name, review.action_rows(spark, [(1, 1, "accept", items[0]["id"], None, None, None)])).count() == 0
    out = service.export_review(name, "ANONYMIZE").where("doc_id = 1").first()
    assert out["output_text"] == "Call [PHONE_1] or [PHONE_1]. Bye." and [tuple(x)[1:] for x in out["legend"]] == [("[PHONE_1]", "PHONE", 2)]
    assert service.preview(name, "REDACT")[0].where("doc_id = 1").first()["output_text"] == "Call [REDACTED] or [REDACTED]. Bye."
    state = service.state(name).where("doc_id = 1").first()
    assert state["counts"]["accepted"] == 2 and state["counts"]["unresolved_high_risk"] == 0 and len(state["layers"]) == 4
    assert as_json(service.state(name)).count() == 2
    flipped = review.flip(service.items(name), 1, items[0]["id"], 2).first()
    assert flipped["type"] == "dismiss"
    with pytest.raises(SpanError):
        service.items("nosuchname")
    with pytest.raises(ValueError):
        service.preview(name, "SHRED")


def test_session_export(spark, tmp_path):
    service = Service(spark, f"file://{tmp_path}/store")
    docs = spark.createDataFrame([(1, "Ann met Bob.")], "doc_id long, text string")
    own = spark.createDataFrame([(1, "x", 0, 3, "Ann", "PERSON", None), (1, "y", 8, 11, "Bob", "PERSON", None)], "doc_id long, id string, start int, end int, text string, type string, normalized_value string")
    name = service.init_session(docs, own)
    wanted = spark.createDataFrame([(1, 0, "y")], "doc_id long, ord int, id string")
    text, legend = service.export(name, wanted, "ANONYMIZE")
    assert text.first()["output_text"] == "Ann met [PERSON_1]." and legend.count() == 1
    for bad in ([(1, 0, "z")], [(1, 0, "x"), (1, 1, "x")]):
        with pytest.raises(SpanError):
            service.export(name, spark.createDataFrame(bad, "doc_id long, ord int, id string"), "REDACT")
    with pytest.raises(SpanError):
        service.session("missing")


def test_second_looks(spark):
    docs = spark.createDataFrame([(1, "Anna Lee wrote. Later anna came, and LEE went; see 10.0.0.1 or https://x.org/a.")], "doc_id long, text string")
    hidden = spark.createDataFrame([(1, 0, 8, "Anna Lee", 0.9)], "doc_id long, start int, end int, text string, confidence double")
    assert sorted(r["text"] for r in consistency.leaked_parts(docs, hidden).collect()) == ["LEE", "anna"]
    assert {(r["kind"], r["text"]) for r in consistency.extra_formats(docs, hidden).collect()} == {("IP", "10.0.0.1"), ("URL", "https://x.org/a.")}
    marked = spark.createDataFrame([(1, 0, 5, "ORG", "v"), (1, 10, 12, "ORG", "v"), (1, 20, 22, "ORG", "v"), (1, 30, 32, "ORG", "w")], "doc_id long, start int, end int, type string, normalized_value string")
    assert sorted(r["start"] for r in consistency.repeated_values(marked, hidden).collect()) == [10, 20]
    truth = spark.createDataFrame([(1, "ORG", 1, 2), (1, "ORG", 50, 52)], "doc_id long, type string, start int, end int")
    assert tuple(consistency.scored(marked, truth).first()) == ("ORG", 4, 2, 0.25, 0.5)
    mixed = spark.createDataFrame([(1, 0, 5, "ORG"), (1, 3, 9, "PERSON"), (1, 9, 12, "PERSON")], "doc_id long, start int, end int, type string")
    assert [(r["a_type"], r["b_type"]) for r in consistency.conflicts(mixed).collect()] == [("ORG", "PERSON")]


def test_highlight_and_selection(spark):
    rows = spark.createDataFrame([(1, "Ask Bo or Bo.", "Bo"), (2, "Ask", "Bo"), (3, "", "")], "k int, sentence string, value string")
    got = rows.orderBy("k").select(scalars.highlight("sentence", "value").alias("h")).select("h.*").collect()
    assert [tuple(r) for r in got] == [("Ask ", "Bo", " or Bo."), ("… ", "Bo", " …"), ("", "", "")]
    texts = spark.createDataFrame([(1, "a\U0001f600b\U0001f601 c", 5, 1), (2, "a\U0001f600b", 2, 9), (3, "ab  c", 2, 4), (4, "ab", 1, 1), (5, "\uffffab", 0, 2), (6, None, 0, 1)], "k int, text string, a int, b int")
    found = texts.select("k", scalars.selected_range("text", scalars.from_utf16("text", F.col("a")), scalars.from_utf16("text", F.col("b"))).alias("r")).orderBy("k").collect()
    assert [r["r"] and tuple(r["r"]) for r in found] == [(1, 4), (2, 3), None, None, (0, 2), None]
