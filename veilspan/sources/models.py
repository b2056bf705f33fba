"""Connectors to language models, and their settings.

A client has ``complete(system, user) -> str``. The network calls go through a function that is passed in, so
everything runs offline with a stand-in.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.contract import SpanError

Transport = Callable[[str, dict[str, str], bytes, float], bytes]


def http_post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> bytes:
    """The default transport."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, data=body, headers=headers, method="POST"), timeout=timeout) as reply:  # noqa: S310
        return reply.read()


@dataclass(frozen=True)
class HostedModel:
    """A hosted completion service; the text blocks of a reply are joined."""

    url: str
    model: str
    key: str = ""
    max_tokens: int = 1024
    transport: Transport = http_post

    def complete(self, *, system: str, user: str) -> str:
        body = {"model": self.model, "max_tokens": self.max_tokens, "system": system, "messages": [{"role": "user", "content": user}]}
        raw = self.transport(self.url, {"content-type": "application/json", "x-api-key": self.key}, json.dumps(body).encode(), 120.0)
        return "".join(b.get("text", "") for b in json.loads(raw).get("content", []) if b.get("type") == "text")


@dataclass(frozen=True)
class LocalModel:
    """A chat endpoint on this host, asked for JSON; a reply without content is an empty text."""

    url: str
    model: str
    timeout: float = 120.0
    transport: Transport = http_post

    def complete(self, *, system: str, user: str) -> str:
        body = {"model": self.model, "stream": False, "format": "json", "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        url = self.url.rstrip("/")
        try:
            raw = self.transport(f"{url}/api/chat", {"content-type": "application/json"}, json.dumps(body).encode(), self.timeout)
        except OSError as error:
            raise SpanError(502, "llm_backend_unavailable", f"no answer from {url}: {error}") from error
        return json.loads(raw).get("message", {}).get("content", "")


@dataclass(frozen=True)
class Replies:
    """A stand-in that answers by the first key found in the prompt, else with ``otherwise``."""

    by_text: dict[str, str] = field(default_factory=dict)
    otherwise: str = '{"entities": []}'

    def complete(self, *, system: str, user: str) -> str:
        return next((reply for key, reply in self.by_text.items() if key in user), self.otherwise)


@dataclass(frozen=True)
class QuotesWord:
    """A stand-in that names the first match of a pattern in the passage as a person."""

    pattern: str

    def complete(self, *, system: str, user: str) -> str:
        found = re.search(self.pattern, user.split("\n\n", 1)[-1])
        return json.dumps({"entities": [{"text": found[0], "type": "PERSON", "reason": "quoted"}] if found else []})


@dataclass(frozen=True)
class Settings:
    """Settings of the service, from the environment."""

    detector: str = "patterns"
    model: str = "cloud"
    hosted_url: str = "https://localhost/v1/messages"
    hosted_model: str = "default"
    local_url: str = "http://localhost:11434"
    local_model: str = "default"
    origins: tuple[str, ...] = ("http://localhost:5173",)

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        named = {f: env[f"VEILSPAN_{f.upper()}"] for f in ("detector", "model", "hosted_url", "hosted_model", "local_url", "local_model") if f"VEILSPAN_{f.upper()}" in env}
        origins = env.get("VEILSPAN_ORIGINS")
        return cls(**named, **({"origins": tuple(o.strip() for o in origins.split(",") if o.strip())} if origins else {}))


def make_client(settings: Settings, name: str | None = None, transport: Transport = http_post) -> HostedModel | LocalModel:
    """The client that a name asks for: cloud, or gemma-local with its aliases gemma_local and local; in any case, with blanks around it."""
    wanted = (name or settings.model).strip().lower()
    if wanted == "cloud":
        return HostedModel(settings.hosted_url, settings.hosted_model, os.environ.get("VEILSPAN_KEY", ""), transport=transport)
    if wanted in ("gemma-local", "gemma_local", "local"):
        return LocalModel(settings.local_url, settings.local_model, transport=transport)
    raise SpanError(500, "unknown_model_flag", f"the model must be cloud or gemma-local, not {wanted!r}")
