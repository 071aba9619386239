"""Providers and the client against a server in this process."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from memlake.client import RemoteLake
from memlake.operators import evaluate, recall
from memlake.providers import EXTRACTION_RULES, extract_claims, http_embedder, http_generator, no_reply
from memlake.sources import tables


class Handler(BaseHTTPRequestHandler):
    def answer(self):
        length = int(self.headers.get("Content-Length") or 0)
        body = json.loads(self.rfile.read(length)) if length else None
        if self.path == "/api/embeddings":
            code, said = (500, {}) if "fail" in body["prompt"] else (200, {"embedding": [float(len(body["prompt"])), 1.0]})
        elif self.path == "/chat/completions":
            asked = body["messages"][-1]["content"]
            text = json.dumps({"entities": [{"id": "e"}], "claims": [{"id": "c", "canonical_text": "Turns were " + str(len(json.loads(asked)["turns"])), "subject_entity_id": "e"}]}) if body.get("response_format") else "" if asked == "empty" else "re: " + asked
            code, said = 200, {"choices": [{"message": {"content": text}}]}
        elif "missing" in self.path:
            code, said = 404, {"error": "no such session"}
        else:
            code, said = 200, {"results": [1], "entries": [2], "deleted": 3, "asked": [self.command, self.path, body, self.headers.get("Authorization")]}
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(said).encode())

    do_GET = do_POST = do_DELETE = answer

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_client(url):
    lake = RemoteLake(url + "/", "key")
    assert lake.remember("s", "hello", metadata={"a": 1})["asked"] == ["POST", "/api/v1/memories", {"sessionId": "s", "content": "hello", "role": "user", "metadata": {"a": 1}}, "Bearer key"]
    assert lake.stats("s 1")["asked"][:2] == ["GET", "/api/v1/memories/stats?sessionId=s+1"]
    assert lake.consolidate_user("u", dryRun=True)["asked"][2] == {"userId": "u", "dryRun": True}
    assert (lake.recall("s", "q"), lake.history("s"), lake.forget("s"), lake.recall_user("u"), lake.forget_user("u")) == ([1], [2], 3, [1], 3)
    with pytest.raises(OSError, match="404.*no such session"):
        lake.history("missing")
    with pytest.raises(OSError):
        RemoteLake("http://127.0.0.1:9", timeout=1).stats("s")
    lake.close()


def test_embedder_is_null_on_failure(spark, url):
    rows = spark.createDataFrame([(1, "abc"), (2, "fail")], "id int, content string")
    assert {r.id: r.embedding for r in http_embedder(url, "m")(rows).collect()} == {1: [3.0, 1.0], 2: None}
    assert http_embedder("http://127.0.0.1:9", "m", 1)(rows).where("embedding IS NULL").count() == 2


def test_generator(spark, url):
    rows = spark.createDataFrame([("hi",), ("empty",)], "prompt string")
    assert [r.reply for r in http_generator(url, "m")(rows).orderBy(F.desc("prompt")).collect()] == ["re: hi", None]
    with pytest.raises(Exception, match="empty"):
        http_generator(url, "m", strict=True)(rows).collect()


def test_extraction_call(spark, url):
    turns = spark.createDataFrame([("w", 0, "user", "a"), ("w", 1, "assistant", "b")], "window_id string, turn int, role string, content string")
    found, entities = extract_claims(turns, http_generator(url, "m", system=EXTRACTION_RULES, json_mode=True, strict=True))
    assert [r.canonical_text for r in found.collect()] == ["Turns were 2"] and entities.count() == 1


def test_timed_runs(spark):
    mem = tables.session_memories(spark, "/root/testdata/sf0.001")
    run = lambda rows, q: recall.recall(rows, q, 3)
    assert evaluate.scale_test(mem, ["the", "tion", "and"], run, 2).count() == 2
    got = evaluate.concurrency_test(mem, ["the", "tion"], run, 5)
    assert got.count() == 5 and got.where("ms <= 0").isEmpty()
    assert evaluate.judged(spark.createDataFrame([("x", "y")], "answer string, expected string"), no_reply).first().correct is False
