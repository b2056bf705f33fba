"""The service's calls by method and path: a table of routes, each a function from a request to a JSON body.

A session holds one document here, numbered 0; its tables are those of ``plans.service``. Every failure is an error envelope
with a code: of a rule that was broken, ``validation_error`` for a request of another form, ``not_found`` for another path,
``internal_error`` for all else.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contract import OUTPUT_MODES, PII_TYPES, SpanError, error_envelope
from ..operators import merge, review
from .service import Service

#: The fields of each request: name to (check, default); a field without a default is required.
REQUIRED = object()
Check = Callable[[Any], bool]


def _text(v: Any) -> bool:
    return isinstance(v, str) and v != ""


def _mode(v: Any) -> bool:
    return v in OUTPUT_MODES


def _flag(v: Any) -> bool:
    return isinstance(v, bool)


def _word(v: Any) -> bool:
    return isinstance(v, str)


def _maybe(check: Check) -> Check:
    return lambda v: v is None or check(v)


def _offset(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and abs(v) < 2**31


FORMS: dict[str, dict[str, tuple[Check, Any]]] = {
    "init_session": {"text": (_text, REQUIRED), "output_mode": (_mode, "REDACT")},
    "export": {"session_id": (_word, REQUIRED), "accepted_span_ids": (lambda v: isinstance(v, list) and all(map(_word, v)), []), "output_mode": (_mode, REQUIRED)},
    "create_review": {"text": (_text, REQUIRED), "output_mode": (_mode, "REDACT"), "run_llm": (_flag, False)},
    "act": {"type": (_word, REQUIRED), "target_id": (_maybe(_word), None), "start": (_maybe(_offset), None), "end": (_maybe(_offset), None), "pii_type": (_maybe(lambda v: v in PII_TYPES), None)},
    "preview": {"output_mode": (_mode, REQUIRED)},
    "export_review": {"output_mode": (_mode, REQUIRED), "confirm": (_flag, False)},
}


def checked(form: str, body: str | bytes | None) -> dict[str, Any]:
    """The fields of a request; one of another form raises a ValueError that names the field."""
    try:
        given = json.loads(body or "{}")
    except ValueError as error:
        raise ValueError(f"body: no JSON ({error})") from error
    if not isinstance(given, dict):
        raise ValueError("body: not an object")
    out = {}
    for name, (check, default) in FORMS[form].items():
        if name not in given and default is REQUIRED:
            raise ValueError(f"{name}: missing")
        out[name] = given.get(name, default)
        if not check(out[name]):
            raise ValueError(f"{name}: not allowed")
    return out


class Api:
    """Answers requests over one service. ``client`` is the model that reviews with ``run_llm`` ask."""

    def __init__(self, service: Service, client=None):
        self.service, self.client = service, client

    def handle(self, method: str, path: str, body: str | bytes | None = None) -> tuple[int, dict]:
        """(status, JSON body) of a request."""
        try:
            for verb, pattern, name in ROUTES:
                found = re.fullmatch(pattern, path)
                if found and verb == method:
                    return 200, getattr(self, name)(*found.groups(), **(checked(name, body) if name in FORMS else {}))
            known = any(re.fullmatch(pattern, path) for _, pattern, _ in ROUTES)
            raise SpanError(405 if known else 404, "method_not_allowed" if known else "not_found", f"{method} {path}")
        except Exception as error:  # noqa: BLE001
            return error_envelope(error)

    def _one(self, text: str) -> DataFrame:
        return self.service.spark.createDataFrame([(0, text)], "doc_id long, text string")

    def health(self) -> dict:
        return self.service.health()

    def init_session(self, text: str, output_mode: str) -> dict:
        name = self.service.init_session(self._one(text).withColumn("output_mode", F.lit(output_mode)))
        return self.get_session(name)

    def get_session(self, name: str) -> dict:
        row = self.service.session(name).first()
        spans = self.service.sessions.get(name, "spans").drop("doc_id") if self.service.sessions.has(name, "spans") else None
        return {"session_id": name, "original_text": row["text"], "spans": [] if spans is None else _rows(spans), "output_mode": row["output_mode"]}

    def export(self, session_id: str, accepted_span_ids: list[str], output_mode: str) -> dict:
        wanted = self.service.spark.createDataFrame([(0, k, i) for k, i in enumerate(accepted_span_ids)], "doc_id long, ord int, id string")
        if not accepted_span_ids:
            return {"output_text": self.service.session(session_id).first()["text"], "legend": []}
        text, legend = self.service.export(session_id, wanted, output_mode)
        return {"output_text": text.first()["output_text"], "legend": _legend(legend)}

    def create_review(self, text: str, output_mode: str, run_llm: bool) -> dict:
        if run_llm and self.client is None:
            raise SpanError(502, "llm_backend_unavailable", "no model is set up")
        name = self.service.create_review(self._one(text), self.client if run_llm else None)
        self.service.reviews.put(name, request=self.service.spark.createDataFrame([(output_mode,)], "output_mode string"))
        return self.get_review(name)

    def get_review(self, name: str) -> dict:
        reviews = self.service.reviews
        documents, items = reviews.get(name, "documents"), self._items(name)
        layers = {r["name"]: r.asDict() for r in reviews.get(name, "layers").drop("doc_id").collect()}
        counts = review.counts(documents, items).drop("doc_id").first().asDict()
        return {"session_id": name, "original_text": documents.first()["text"], "output_mode": reviews.get(name, "request").first()["output_mode"], "layers": [layers[k] for k in ("regex", "dictionary", "ner", "llm")], "queue": _queue(items), "counts": counts}

    def act(self, name: str, type: str, target_id: str | None, start: int | None, end: int | None, pii_type: str | None) -> dict:  # noqa: A002
        """Takes an action into the log, or raises its error; one that fails isn't kept."""
        reviews = self.service.reviews
        log = reviews.get(name, "actions") if reviews.has(name, "actions") else None
        seq = 0 if log is None else log.count()
        new = review.action_rows(self.service.spark, [(0, seq, type, target_id, start, end, pii_type)])
        whole = new if log is None else log.unionByName(new)
        failed = review.action_errors(reviews.get(name, "documents"), reviews.get(name, "findings"), whole).where(F.col("seq") == seq).first()
        if failed:
            raise SpanError(400, failed["error"], f"{type} {target_id or ''}".strip())
        reviews.append(name, actions=new)
        return self.get_review(name)

    def preview(self, name: str, output_mode: str) -> dict:
        self.service.reviews.get(name, "documents")
        text, legend = self.service.preview(name, output_mode)
        return {"output_text": _sound(text.first(), "output_text"), "legend": _legend(legend)}

    def export_review(self, name: str, output_mode: str, confirm: bool) -> dict:
        row = self.service.export_review(name, output_mode, confirm).first()
        if row["gated"]:
            return {"gated": True, "output_text": None, "legend": [], "unresolved": _queue(self._items(name).where("tier = 1 and status = 'pending'"))}
        legend = [{k: e[k] for k in ("token", "type", "occurrences")} for e in row["legend"]]
        return {"gated": False, "output_text": _sound(row, "output_text"), "legend": legend, "unresolved": []}

    def _items(self, name: str) -> DataFrame:
        return merge.linked(self.service.items(name))


ROUTES = [
    ("GET", "/api/health", "health"), ("POST", "/api/session/init", "init_session"), ("GET", "/api/session/([^/]+)", "get_session"), ("POST", "/api/export", "export"), ("POST", "/api/review", "create_review"),
    ("GET", "/api/review/([^/]+)", "get_review"), ("POST", "/api/review/([^/]+)/action", "act"), ("POST", "/api/review/([^/]+)/preview", "preview"), ("POST", "/api/review/([^/]+)/export", "export_review"),
]


def _rows(frame: DataFrame) -> list[dict]:
    return [json.loads(r) for r in frame.select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]


def _queue(items: DataFrame) -> list[dict]:
    fields = ("id", "start", "end", "text", "type", "confidence", "sources", "reason", "normalized_value", "tier", "linked", "linked_count", "status", "sentence")
    return _rows(review.ordered(items).orderBy("place").select(*fields))


def _legend(entries: DataFrame) -> list[dict]:
    return _rows(entries.orderBy("ord").select("token", "type", "occurrences"))


def _sound(row, name: str) -> str:
    if row["error"]:
        raise SpanError(400, row["error"], "accepted items overlap")
    return row[name]


class ApiError(Exception):
    """An answer other than success, with its status and the envelope's code."""

    def __init__(self, status: int, code: str, detail: str | None):
        super().__init__(detail or code)
        self.status, self.code, self.detail = status, code, detail


class Client:
    """Calls the routes through ``send``, a function (method, path, body) -> (status, body text)."""

    def __init__(self, send: Callable[[str, str, str | None], tuple[int, str]]):
        self.send = send

    def _request(self, method: str, path: str, **fields) -> dict:
        status, body = self.send(method, path, json.dumps(fields) if method == "POST" else None)
        try:
            answer = json.loads(body)
        except ValueError:
            answer = None
        if 200 <= status < 300 and isinstance(answer, dict):
            return answer
        known = answer if isinstance(answer, dict) and "error" in answer else {"error": "unknown_error", "detail": f"status {status}"}
        raise ApiError(status, known["error"], known.get("detail"))

    def health(self) -> dict:
        return self._request("GET", "/api/health")

    def init_session(self, text: str, output_mode: str = "REDACT") -> dict:
        return self._request("POST", "/api/session/init", text=text, output_mode=output_mode)

    def get_session(self, name: str) -> dict:
        return self._request("GET", f"/api/session/{name}")

    def create_review(self, text: str, output_mode: str = "REDACT", run_llm: bool = False) -> dict:
        return self._request("POST", "/api/review", text=text, output_mode=output_mode, run_llm=run_llm)

    def get_review(self, name: str) -> dict:
        return self._request("GET", f"/api/review/{name}")

    def act(self, name: str, type: str, **action) -> dict:  # noqa: A002
        return self._request("POST", f"/api/review/{name}/action", type=type, **action)

    def preview(self, name: str, output_mode: str) -> dict:
        return self._request("POST", f"/api/review/{name}/preview", output_mode=output_mode)

    def export(self, name: str, output_mode: str, confirm: bool = False) -> dict:
        return self._request("POST", f"/api/review/{name}/export", output_mode=output_mode, confirm=confirm)


def local(api: Api) -> Client:
    """A client of an Api in this process; bodies go through JSON as they would over a wire."""

    def send(method: str, path: str, body: str | None) -> tuple[int, str]:
        status, answer = api.handle(method, path, body)
        return status, json.dumps(answer)

    return Client(send)
