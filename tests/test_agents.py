"""Contents, hot files, indexes, sessions, settings and imported rows."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from meterlake import config, store
from meterlake.functions import content
from meterlake.operators import logs
from meterlake.plans.adapter import usage
from meterlake.sources import hot

NOW = datetime(2024, 1, 31, 12, tzinfo=timezone.utc)


def test_contents(spark):
    values = ['"ab"', '["a", {"text": "bc"}, {"content": "def"}, 5, null]', '{"text": 12}', "true", "null", "{", '{"b": 1, "a": [2]}', '[["x", ["y"]], {"content": "z"}]', None]
    v = F.try_parse_json("j")
    rows = spark.createDataFrame(list(enumerate(values)), "i int, j string").select("i", content.message_text(v), content.message_chars(v), content.render(v)).orderBy("i").collect()
    assert [r[1] for r in rows] == ["ab", "abc", "", "", "", "", "", "", ""]
    assert [r[2] for r in rows] == [2, 6, 2, 4, 0, 0, 0, 1, 0]
    assert [r[3] for r in rows] == ["ab", "a\nbc\ndef\n5\n", '{"text":12}', "true", "", "", '{"a":[2],"b":1}', "x\ny\nz", ""]


def test_workspace_and_models(spark):
    folders = ["/h/sessions/C%3A%5Ca+b/id", "/h/sessions/id", "/h/s/%zz/id", "/h/s/plain/id", "", None]
    got = [r[0] for r in spark.createDataFrame([(f, i) for i, f in enumerate(folders)], "f string, i int").orderBy("i").select(content.workspace_of(F.col("f"))).collect()]
    assert got == ["C:\\a+b", None, None, None, None, None]
    blobs = spark.createDataFrame([(1, "gpt-5 kimi-k3"), (1, "gemini-3.6-flash-high"), (2, "claude-opus"), (2, "claude-sonnet"), (3, "nothing"), (3, None)], "c int, t string")
    assert {r.c: r.model for r in logs.conversation_models(blobs, "c", "t").collect()} == {1: "gemini-3.6-flash-high", 2: "claude-sonnet"}


def test_hot_files(spark, tmp_path):
    (tmp_path / "9router").mkdir()
    (tmp_path / "litellm").mkdir()
    record = lambda **k: json.dumps({"timestamp": "2024-01-31T11:50:00Z", "promptTokens": 3, "model": "m"} | k)
    lines = [record(id=1), record(id=1, promptTokens=9), record(id=2, timestamp="2024-01-31T10:00:00Z"), record(id=3, promptTokens=0), record(id=4, promptTokens=0, cost=0.5), "no json", "[1]", record(id=5, timestamp=None), record(tokens={"prompt_tokens": 7, "cached_tokens": 2}, provider="p", timestamp=1706701800)]
    (tmp_path / "9router/usage-history.jsonl").write_text("\n".join(lines))
    (tmp_path / "litellm/other.jsonl").write_text(record(id=9))
    got = {r.id: r for r in hot.read_hot(spark, str(tmp_path), NOW).collect()}
    assert set(got) == {"hotlive:9router:1", "hotlive:9router:4", "hotlive:9router:2024-01-31T11:50:00.000Z:7:0"}
    assert (got["hotlive:9router:1"].input_tokens, got["hotlive:9router:4"].pricing_status) == (3, "priced")
    last = got["hotlive:9router:2024-01-31T11:50:00.000Z:7:0"]
    assert (last.total_tokens, last.workspace, last.estimated_cost) == (9, "provider:p", None)


def test_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in ("a.jsonl", "in/b.jsonl", "c.jsonl"):
        (tmp_path / f).write_text(f'{{"f": "{f}"}}\n')
    (tmp_path / "sessions.json").write_text(json.dumps({"x": {"sessionFile": "a.jsonl"}, "y": ["in/../in/b.jsonl", 5, None, "a.jsonl"], "z": "text"}))
    assert sorted(r.value for r in hot.follow_index(spark, [str(tmp_path)]).collect()) == ['{"f": "a.jsonl"}', '{"f": "in/b.jsonl"}']


def test_sessions_and_summaries(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, session_id string")
    at = datetime(2024, 1, 1)
    sessions = spark.createDataFrame([("a", at, None, "/w"), ("a", at.replace(day=2), at.replace(day=3), None), ("", at, at, "/no")], "session_id string, started_at timestamp, ended_at timestamp, cwd string")
    assert [tuple(r) for r in logs.with_sessions(rows, sessions).orderBy("i").collect()] == [(1, "a", at.replace(day=3), None), (2, "b", None, None), (3, None, None, None)]
    known = rows.withColumns({"ts": F.when(F.col("i") > 1, F.lit(at)), "workspace": F.when(F.col("i") == 1, "/own")})
    assert [tuple(r) for r in logs.with_sessions(known, sessions).orderBy("i").collect()] == [(1, "a", at.replace(day=3), "/own"), (2, "b", at, None), (3, None, at, None)]
    kept = logs.replace_summaries(rows, rows.filter("i = 1").withColumn("i", F.col("i") + 10), ["session_id"])
    assert sorted(r.i for r in kept.collect()) == [2, 3, 11]
    assert logs.enabled(rows.withColumn("agent", F.col("session_id")), {"a": False, "b": True}).count() == 2


def test_settings(tmp_path):
    path = str(tmp_path / "new" / "config.json")
    assert config.load(path) == config.DEFAULTS
    good = {"inputPer1M": 1, "outputPer1M": 2.5}
    config.set_custom_rates(path, {"m": good, " ": good, "bad": {"inputPer1M": "1", "outputPer1M": 2}, "nan": {"inputPer1M": float("nan"), "outputPer1M": 2}})
    config.save(path, config.merge(config.load(path), {"agents": {"grok": False}}))
    assert config.load(path)["pricing"]["customRates"] == {"m": good} and config.load(path)["agents"] == {"grok": False}
    assert config.rate_tuples(config.set_custom_rates(path, {"n": good}, replace=True)) == {"n": (1, 2.5, None, None)}
    (tmp_path / "new" / "config.json").write_text("{")
    assert config.load(path) == config.DEFAULTS


@pytest.mark.parametrize("legacy", [False, True])
def test_imported(spark, tmp_path, legacy):
    rows = usage(spark, "/root/testdata/sf0.001")
    store.save_imported(rows.filter("seq < 60"), str(tmp_path / "now"))
    store.save_imported(rows.filter("seq between 40 and 99").withColumn("total_tokens", F.col("total_tokens") + 1), str(tmp_path / "old"))
    got = store.load_imported(spark, str(tmp_path / "now"), str(tmp_path / "old") if legacy else None)
    assert got.select("id").distinct().count() == got.count() == rows.filter(f"seq < {100 if legacy else 60}").count()
