"""Score providers: an OpenAI-compatible endpoint over HTTPS, and a scripted one for tests."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass


class ProviderError(RuntimeError):
    """A reply that cannot be used."""


@dataclass(frozen=True)
class ChatEndpoint:
    """Calls ``/chat/completions`` of an endpoint; HTTPS only."""

    base_url: str
    key: str
    model: str
    timeout: float = 120.0

    def __post_init__(self):
        if not self.base_url.startswith("https://"):
            raise ValueError("the endpoint must use HTTPS")

    def request(self, system: str, user: str, max_tokens: int = 4_096, temperature: float = 0.0, json_reply: bool = True) -> urllib.request.Request:
        body: dict = {"model": self.model, "max_tokens": max_tokens, "temperature": temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if json_reply:
            body["response_format"] = {"type": "json_object"}
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        return urllib.request.Request(self.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)

    def complete(self, system: str, user: str, **settings) -> str:
        with urllib.request.urlopen(self.request(system, user, **settings), timeout=self.timeout) as reply:
            return content_of(reply.read())


def content_of(body: bytes | str) -> str:
    """The final text of a completion's JSON, without an inline reasoning block."""
    try:
        choice = json.loads(body)["choices"][0]
        content = choice["message"]["content"]
    except (ValueError, LookupError, TypeError) as error:
        raise ProviderError("invalid completion envelope") from error
    if choice.get("finish_reason") == "length":
        raise ProviderError("completion is truncated")
    text = content.strip() if isinstance(content, str) else ""
    if text.startswith("<think>"):
        _, closed, text = text.partition("</think>")
        text = text.strip()
        if not closed:
            raise ProviderError("reasoning is truncated")
    if not text or "<think>" in text or "</think>" in text:
        raise ProviderError("no usable final text")
    return text


def batch_prompt(heading: str, closing: str) -> Callable[[list[dict]], str]:
    """A batch's user prompt: query and its views, each candidate's fields and text, the ids that are expected."""

    def prompt(rows: list[dict]) -> str:
        first = rows[0]
        parts = [heading, first["query"], "", first.get("meta_query") or "", "", first.get("keywords_query") or ""]
        for r in rows:
            parts.append(f"---\ncandidate_id: {r['candidate_id']}\nrank: {r['rank']}\nfusion_score: {r.get('fusion_score')}\nhits: {json.dumps(r.get('hits') or [], ensure_ascii=False)}\n{r['document_text']}")
        return "\n".join([*parts, closing, json.dumps([r["candidate_id"] for r in rows], ensure_ascii=False)])

    return prompt


def scripted(replies: Mapping[str, str]) -> Callable[[], Callable[[list[dict]], str]]:
    """A provider whose reply to a batch is found by its first candidate id."""

    def make() -> Callable[[list[dict]], str]:
        def ask(rows: list[dict]) -> str:
            try:
                return replies[rows[0]["candidate_id"]]
            except KeyError as error:
                raise ProviderError("the script has no reply") from error

        return ask

    return make
