"""Sessions and reviews by route, and the export button."""

import json

import pytest

from veilspan.operators import export_button
from veilspan.plans.routes import Api, ApiError, Client, local
from veilspan.plans.service import Service
from veilspan.queries import NOTE
from veilspan.sources.models import Replies


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    return Api(Service(spark, f"file://{tmp_path_factory.mktemp('store')}"))


@pytest.fixture(scope="module")
def client(api):
    return local(api)


def statuses(state):
    return {i["id"]: i["status"] for i in state["queue"]}


def test_a_review_from_queue_to_export(client):
    state = client.create_review(NOTE)
    name = state["session_id"]
    layers = {x["name"]: x["status"] for x in state["layers"]}
    assert layers == {"regex": "ok", "dictionary": "ok", "ner": "ok", "llm": "skipped"} and state["original_text"] == NOTE and state["output_mode"] == "REDACT"
    tiers = [i["tier"] for i in state["queue"]]
    assert tiers == sorted(tiers) and all(i["sentence"] and i["reason"] and i["status"] == "pending" for i in state["queue"])
    first, second = (i for i in state["queue"] if i["type"] == "PHONE")
    assert first["linked_count"] == 1 and first["linked"] == [{"start": second["start"], "end": second["end"]}] and first["normalized_value"] == "0413555760"
    after = client.act(name, "accept", target_id=first["id"])
    assert statuses(after)[first["id"]] == statuses(after)[second["id"]] == "accepted" and after["counts"]["accepted"] == 2
    back = client.act(name, "undo")
    assert set(statuses(back).values()) == {"pending"}
    at = NOTE.index("partner")
    added = client.act(name, "add_missed", start=at, end=at + 7, pii_type="OTHER")
    assert statuses(added)[f"manual:{at}-{at + 7}"] == "accepted" and next(i for i in added["queue"] if i["start"] == at)["tier"] == 1
    assert f"manual:{at}-{at + 7}" not in statuses(client.act(name, "undo"))
    held = client.export(name, "REDACT")
    assert held["gated"] and held["output_text"] is None and held["legend"] == [] and {i["tier"] for i in held["unresolved"]} == {1}
    for i in held["unresolved"]:
        if statuses(client.get_review(name))[i["id"]] == "pending":
            client.act(name, "accept", target_id=i["id"])
    done = client.export(name, "ANONYMIZE")
    assert not done["gated"] and "[PHONE_1]" in done["output_text"] and done["unresolved"] == []
    assert [e["occurrences"] for e in done["legend"] if e["token"] == "[PHONE_1]"] == [2] and "0413" not in json.dumps(done["legend"])
    assert "[REDACTED]" in client.preview(name, "REDACT")["output_text"] and "[EMAIL_1]" in client.preview(name, "ANONYMIZE")["output_text"]


def test_errors_are_envelopes(api, client):
    name = client.create_review("Call 0413 552 760 now.")["session_id"]
    for kind, action, code in (("accept", {"target_id": "m:9-9"}, "unknown_item"), ("add_missed", {}, "missing_selection"), ("add_missed", {"start": 5, "end": 99}, "span_offsets_out_of_range"), ("undo", {}, "nothing_to_undo"), ("fly", {}, "unknown_action")):
        with pytest.raises(ApiError) as e:
            client.act(name, kind, **action)
        assert (e.value.status, e.value.code) == (400, code)
    assert not api.service.reviews.has(name, "actions")  # none of them is kept
    for method, path, body, status, code in (
        ("POST", "/api/review", '{"text": ""}', 422, "validation_error"), ("POST", "/api/review", '{"text": "x", "output_mode": "SHRED"}', 422, "validation_error"), ("POST", "/api/review", "[]", 422, "validation_error"), ("POST", "/api/review", "{", 422, "validation_error"),
        ("POST", f"/api/review/{name}/action", "{}", 422, "validation_error"), ("POST", f"/api/review/{name}/action", '{"type": "add_missed", "pii_type": "SHOE"}', 422, "validation_error"), ("GET", "/api/review/nosuch", None, 404, "session_not_found"),
        ("POST", "/api/review/nosuch/preview", '{"output_mode": "REDACT"}', 404, "session_not_found"), ("GET", "/api/shoes", None, 404, "not_found"), ("DELETE", "/api/health", None, 405, "method_not_allowed"), ("POST", "/api/review", '{"text": "x", "run_llm": true}', 502, "llm_backend_unavailable"),
    ):
        got, answer = api.handle(method, path, body)
        assert (got, answer["error"]) == (status, code) and set(answer) == {"error", "detail"}
    assert api.handle("GET", "/api/health") == (200, {"status": "ok", "detector": "patterns"})


def test_sessions_and_exports_of_submitted_spans(spark, api, client):
    state = client.init_session("Ann met Bob and Ann.", "ANONYMIZE")
    assert state == {"session_id": state["session_id"], "original_text": "Ann met Bob and Ann.", "spans": [], "output_mode": "ANONYMIZE"} == client.get_session(state["session_id"])
    assert api.handle("POST", "/api/export", json.dumps({"session_id": state["session_id"], "output_mode": "REDACT"})) == (200, {"output_text": "Ann met Bob and Ann.", "legend": []})
    own = spark.createDataFrame([(0, "a", 0, 3, "Ann", "PERSON", None), (0, "b", 8, 11, "Bob", "PERSON", None), (0, "c", 1, 9, "nn met B", "ORG", None)], "doc_id long, id string, start int, end int, text string, type string, normalized_value string")
    api.service.sessions.put(state["session_id"], spans=own)
    ask = lambda ids: api.handle("POST", "/api/export", json.dumps({"session_id": state["session_id"], "accepted_span_ids": ids, "output_mode": "ANONYMIZE"}))
    assert ask(["b", "a"]) == (200, {"output_text": "[PERSON_1] met [PERSON_2] and Ann.", "legend": [{"token": "[PERSON_1]", "type": "PERSON", "occurrences": 1}, {"token": "[PERSON_2]", "type": "PERSON", "occurrences": 1}]})
    assert [ask(x)[1]["error"] for x in (["z"], ["a", "c"])] == ["unknown_span_id", "overlapping_accepted_spans"]
    assert len(client.get_session(state["session_id"])["spans"]) == 3


def test_a_model_is_asked_where_the_request_says_so(spark, tmp_path):
    own = local(Api(Service(spark, f"file://{tmp_path}/s"), Replies({"supervisor": '{"entities": [{"text": "her supervisor", "type": "OTHER"}]}'})))
    state = own.create_review(NOTE, run_llm=True)
    assert {x["name"]: x["status"] for x in state["layers"]}["llm"] == "ok" and state["queue"][-1]["tier"] == 3


def test_answers_that_are_no_envelopes():
    for status, body in ((500, "<html>"), (502, "[]"), (404, '{"x": 1}'), (200, "oops")):
        with pytest.raises(ApiError) as e:
            Client(lambda *a, s=status, b=body: (s, b)).health()
        assert (e.value.status, e.value.code) == (status, "unknown_error")


def test_the_export_button(spark):
    logs = {1: [], 2: ["press-"], 3: ["press+"], 4: ["press+", "confirm"], 5: ["press+", "risk_changed", "confirm"], 6: ["press-", "again"], 7: ["confirm", "again"], 8: ["press+", "cancel", "press-"], 9: ["press+", "press+", None, "fly", "confirm", "confirm"]}
    rows = [(d, k, None if e is None else e.rstrip("+-"), e is not None and e.endswith("+")) for d, log in logs.items() for k, e in enumerate(log)]
    got = {r["doc_id"]: r["phase"] for r in export_button.phases(spark.createDataFrame(rows, "doc_id long, seq int, event string, gated boolean")).collect()}
    assert got == {2: "done", 3: "armed", 4: "done", 5: "idle", 6: "idle", 7: "idle", 8: "done", 9: "done"}
    said = spark.createDataFrame([("idle", 0), ("idle", 3), ("armed", 3), ("done", 3), ("armed", 0)], "phase string, n int").select(export_button.label("phase", "n").alias("l")).collect()
    assert [r["l"] for r in said] == ["Export", "3 high-risk unresolved — review first", "Export anyway", "Exported", "Export"]
