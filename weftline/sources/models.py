"""Embedding and judge clients over HTTP, in the request format that most model servers share.

They are made where they run, once in each Python worker; nothing but the settings is sent there."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Sequence

from weftline.config import Settings
from weftline.functions.vectors import Embedder, Transient, hashing_embedder
from weftline.operators.judge import RESPONSE_SCHEMA, Judge, answer_text, flatten_messages, messages, provider, strip_schema

TIMEOUT_S = 120.0


def post(url: str, body: dict, key: str = "", timeout: float = TIMEOUT_S) -> dict:
    """The JSON answer; rate limits, server errors and lost connections are ``Transient``, other refusals are not."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        said = f"{e.code}: {e.read(500).decode('utf-8', 'replace')}"
        if e.code == 429 or e.code >= 500:
            raise Transient(said) from e
        raise ValueError(said) from e
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Transient(str(e)) from e


def remote_embedder(settings: Settings) -> Embedder:
    if not settings.api_key or not settings.remote_url:
        raise ValueError("the remote embedder needs api_key and remote_url")

    def embed(texts: Sequence[str]) -> list[list[float]]:
        body = {"model": settings.embedding_model, "input": list(texts), "dimensions": settings.embedding_dim}
        rows = post(f"{settings.remote_url.rstrip('/')}/embeddings", body, settings.api_key)["data"]
        placed = {row["index"]: row["embedding"] for row in rows}  # servers may answer in any order
        return [placed[i] for i in range(len(texts))]

    return embed


def _chat(settings: Settings, url: str, key: str, cached: bool) -> Judge:
    schema = {"type": "json_schema", "json_schema": {"name": "verdicts", "strict": True, "schema": strip_schema(RESPONSE_SCHEMA)}}

    def judge(system: str, prefix: str, asked: str, strict: bool) -> str | None:
        said = messages(system, prefix, asked, schema_hint=not strict)
        body = {"model": settings.judge_model, "messages": said if cached else flatten_messages(said), "response_format": schema if strict else {"type": "json_object"}}
        return answer_text(post(f"{url.rstrip('/')}/chat/completions", body, key)["choices"][0]["message"])

    return judge


def remote_judge(settings: Settings) -> Judge:
    """The note goes as a part that the server may cache."""
    if not settings.remote_url:
        raise ValueError("the remote judge needs remote_url")
    return _chat(settings, settings.remote_url, settings.api_key, True)


def local_judge(settings: Settings) -> Judge:
    """A server of one's own: plain messages, no key."""
    return _chat(settings, settings.local_url, "", False)


def embedder(settings: Settings) -> Embedder:
    """The embedder that the settings name."""
    return hashing_embedder(settings.embedding_dim) if settings.embedding_model == "hashing" else remote_embedder(settings)


def judge(settings: Settings) -> Judge:
    """The judge that the settings name."""
    return provider(settings, remote_judge, local_judge)
