"""Readers end to end over small folders, and the stream."""

from __future__ import annotations

import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from meterlake.schema import conform
from meterlake.sources.connectors import read_agent

KEY = b"0123456789abcdef0123456789abcdef"


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    h = tmp_path_factory.mktemp("home")

    def put(path, text):
        (h / path).parent.mkdir(parents=True, exist_ok=True)
        (h / path).write_text(text)

    put(".claude/projects/pa/x.jsonl", '{"message":{"usage":{"input_tokens":5,"cache_read_input_tokens":2},"model":"claude-opus-4"},"timestamp":"2026-07-15T00:00:00Z"}\n')
    put(".gemini/a.json", json.dumps({"messages": [{"usage": {"promptTokenCount": 10, "cached": 4, "candidatesTokenCount": 3}, "model": "g"}]}))
    put(".openclaw/s.jsonl", '{"type":"model_change","model":"m1","cwd":"/w"}\n{"type":"message","message":{"usage":{"input_tokens":4,"output_tokens":1}}}\n')
    turn = {"sessionUpdate": "turn_completed", "prompt_id": "p", "usage": {"inputTokens": 100_000, "outputTokens": 2000, "cachedReadTokens": 80_000, "cacheCreationTokens": 1200, "costUsdTicks": 2_991_092_000, "modelUsage": {"grok-4.5": {}}}}
    put(".grok/s/updates.jsonl", json.dumps({"timestamp": 1_784_000_000, "params": {"sessionId": "s", "update": turn}}) + "\n")
    put(".qwencoder/d.json", json.dumps({"data": {"models": [{"model": "q", "input_tokens": 1000, "output_tokens": 200, "requests": 3}]}}))
    put(".9router/usage-history.jsonl", "\n".join(json.dumps({"id": i, "timestamp": f"2026-07-15T0{i}:00:00Z", "model": "kimi-k3", "promptTokens": 10, "completionTokens": 5, "provider": "p"}) for i in (0, 1, 2, 2)))
    day = {"requests": 4, "promptTokens": 100, "completionTokens": 20, "cost": 1.0}
    put(".9router/usage-daily.json", json.dumps({"2026-07-14": day | {"byModel": {"kimi-k3|p": day | {"provider": "p"}}}}))
    (h / ".hermes").mkdir()
    with sqlite3.connect(h / ".hermes/state.db") as db:
        db.execute("create table sessions (id text, model text, input_tokens int, output_tokens int, started_at text, cwd text)")
        db.execute("insert into sessions values ('s1', 'k', 1000, 50, '2026-07-15T00:00:00Z', '/w')")
        db.execute("create table session_model_usage (session_id text, model text, input_tokens int, output_tokens int, reasoning_tokens int, api_call_count int)")
        db.execute("insert into session_model_usage values ('s1', 'k', 600, 50, 10, 3)")
    plain = b"glm-5-2 " * 20 + b"Input tokens\x15" + struct.pack("<f", 15231) + b"Output tokens\x00\x15" + struct.pack("<f", 1351)
    made = spark.range(1).select(F.aes_encrypt(F.lit(plain), F.lit(KEY), F.lit("GCM"))).first()[0]
    (h / ".codeium/windsurf").mkdir(parents=True)
    (h / ".codeium/windsurf/a.pb").write_bytes(bytes(made))
    (h / ".codeium/windsurf/b.pb").write_bytes(b"x" * 1600)
    return str(h)


def counts(spark, home, agent, **options):
    return sorted((r.model or "", r.input_tokens, r.output_tokens, r.cache_read_tokens, bool(r.estimated)) for r in read_agent(spark, agent, [home], **options).collect())


@pytest.mark.parametrize(
    ("agent", "expect"),
    [
        ("claude-code", [("claude-opus-4", 5, 0, 2, False)]),
        ("gemini", [("g", 6, 3, 4, False)]),
        ("openclaw", [("m1", 4, 1, 0, False)]),
        ("grok", [("grok-4.5", 20_000, 2000, 80_000, False)]),
        ("qwencoder", [("q", 1000, 200, 0, True)]),
        ("9router", [("kimi-k3", 10, 5, 0, False)] * 3 + [("kimi-k3", 100, 20, 0, True)]),
        ("hermes", [("k", 400, 0, 0, True), ("k", 600, 60, 0, False)]),
    ],
)
def test_reader(spark, home, agent, expect):
    assert counts(spark, home, agent) == expect


def test_trajectories(spark, home):
    assert counts(spark, home, "windsurf", key=KEY) == [("glm-5-2", 15231, 1351, 0, False), ("windsurf-cascade", 130, 70, 0, True)]


def test_stream(spark, tmp_path):
    from meterlake.store import read_snapshot
    from meterlake.streaming import ingest

    folder, snap = tmp_path / "in", str(tmp_path / "snap")
    folder.mkdir()
    row = {"seq": 1, "id": "a", "agent": "amp", "model": "kimi-k3", "ts": "2026-07-15T00:00:00Z", "input_tokens": 10, "output_tokens": 1, "cache_read_tokens": 0, "cache_write_tokens": 0}
    for n, more in enumerate([{}, {"id": "b", "ts": "2026-07-15T01:00:00Z"}, {"input_tokens": 50}]):
        (folder / f"{n}.json").write_text(json.dumps(row | more) + "\nbroken\n")
        ingest.ingest(ingest.stream_rows(spark, str(folder)), snap, str(tmp_path / "check")).awaitTermination(120)
    got = {r.id: r.input_tokens for r in read_snapshot(spark, snap).collect()}
    assert got == {"a": 50, "b": 10}
    assert conform(read_snapshot(spark, snap)).filter("estimated_cost > 0").count() == 2
