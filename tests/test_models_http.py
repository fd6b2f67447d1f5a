from __future__ import annotations

import io
import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from tests.test_index_engine import QUERY, judge_all, make, place, settings  # noqa: F401

from weftline.config import Settings
from weftline.functions.vectors import Transient, embed_batched, hashing_embedder
from weftline.operators.judge import RESPONSE_SCHEMA, acceptable
from weftline.plans.engine import Engine
from weftline.plans.service import Service, server
from weftline.sources import models

ITEM = {"candidate_id": 1, "type": "mention", "confidence": 2, "why": "w", "anchor": {"mode": "wrap", "expect": "x", "insert_text": None}, "target_is_note": False}


@pytest.fixture
def remote():
    """A model server that keeps what it was asked and fails as told."""
    asked, failures = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers.get("Authorization"), body))
            code = failures.pop(0) if failures else 200
            if self.path.endswith("embeddings"):
                rows = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
                out = {"data": rows[::-1]}
            else:
                out = {"choices": [{"message": {"content": json.dumps({"suggestions": [ITEM]})}}]}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/v1", asked, failures
    http.shutdown()


def test_embedding_over_http(remote):
    url, asked, failures = remote
    s = Settings(embedding_model="m", embedding_dim=2, remote_url=url, api_key="k")
    failures += [503, 429]
    got = embed_batched(["a", "bbb", "cc"], models.embedder(s), batch=2, wait=lambda _: None)
    assert got == [[1.0, 1.0], [3.0, 1.0], [2.0, 1.0]] and [len(b["input"]) for _, _, b in asked] == [2, 2, 2, 1]
    assert asked[0][:2] == ("/v1/embeddings", "Bearer k") and asked[0][2]["dimensions"] == 2 and asked[0][2]["model"] == "m"
    failures += [401]
    with pytest.raises(ValueError, match="401"):
        models.embedder(s)(["a"])
    with pytest.raises(Transient):
        models.post("http://127.0.0.1:9/", {}, timeout=2)
    with pytest.raises(ValueError, match="api_key"):
        models.embedder(Settings(embedding_model="m"))
    assert models.embedder(Settings(embedding_dim=8))(["a b"]) == hashing_embedder(8)(["a b"])


def test_judging_over_http(remote):
    url, asked, _ = remote
    far = models.judge(Settings(judge_provider="remote", judge_model="j", remote_url=url, api_key="k"))
    near = models.judge(Settings(judge_provider="local", judge_model="j", local_url=url))
    assert acceptable(far("s", "p", "q", True)) and acceptable(near("s", "p", "q", False))
    (_, key, strict), (_, none, loose) = asked
    assert key == "Bearer k" and none is None and strict["response_format"]["type"] == "json_schema" and loose["response_format"] == {"type": "json_object"}
    assert strict["messages"][1]["content"][0]["cache_control"] and loose["messages"][1]["content"] == "p\n\nq" and len(loose["messages"]) == 3
    assert "minimum" not in json.dumps(strict["response_format"]) and "minimum" in json.dumps(RESPONSE_SCHEMA)
    with pytest.raises(ValueError, match="api_key"):
        models.judge(Settings(judge_provider="remote", remote_url=url))


def test_schema():
    good = {"suggestions": [ITEM]}
    assert acceptable(json.dumps(good)) and acceptable('said: {"suggestions": []}.')
    for change in ({"confidence": 0}, {"confidence": True}, {"type": "x"}, {"why": None}, {"more": 1}, {"anchor": {"mode": "wrap"}}):
        assert not acceptable(json.dumps({"suggestions": [ITEM | change]}))
    assert not acceptable(json.dumps([])) and not acceptable(None) and not acceptable("{") and not acceptable(json.dumps({"suggestions": {}}))


def test_daemon(spark, place):  # noqa: F811
    service = Service(Engine(spark, settings(place), make, judge_all))
    http = server(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"

    def call(path, body=None):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        with urllib.request.urlopen(urllib.request.Request(base + path, data), timeout=120) as answer:
            return json.load(io.TextIOWrapper(answer, "utf-8"))

    assert call("/health") == {"status": "ok"} and call("/refresh", {"rebuild": False})["indexed"] == 3
    assert call("/status")["notes"] == 3 and call("/suggest", {"buffer": QUERY})["source"]["id"] == "Q"
    for path, body, code in (("/none", None, 404), ("/suggest", {"buffer": 1}, 400), ("/suggest", b"{", 400), ("/refresh", b"[1]", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            call(path, body)
        assert e.value.code == code
    http.shutdown()
