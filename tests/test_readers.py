"""Databases by ranges of rows, tails of files, line numbers of split files, and rollouts with their threads and proxies."""

from __future__ import annotations

import json
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull
from pyspark.sql.types import StructType

from meterlake.sources import files, hot, rollouts, sqlite, tail
from meterlake.sources.connectors import read_agent


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "x y.db")
    with sqlite3.connect(path) as db:
        db.execute("create table big (id integer primary key, name text, score real, raw blob, anything)")
        db.executemany("insert into big values (?, ?, ?, ?, ?)", ((i * 3, f"n{i}" if i % 7 else None, i / 2, b"\xff%d" % i, i if i % 2 else str(i)) for i in range(1_000_000)))
        db.execute("create table small (k text primary key, v) without rowid")
        db.execute("insert into small values ('b', 1), ('a', 'x')")
    return path


def test_a_table_is_read_by_several_tasks(spark, database):
    rows = sqlite.scan(spark, [(database, 0)], "BIG", "id long, name string, _rowid long")
    assert rows.rdd.getNumPartitions() >= 10
    got = rows.agg(F.count("*"), F.sum("id"), F.count("name"), F.countDistinct("id"), F.sum(F.col("id") - F.col("_rowid"))).first()
    assert tuple(got) == (1_000_000, 3 * 999_999 * 500_000, 1_000_000 - 142_858, 1_000_000, 0)
    assert sqlite.scan(spark, [(database, 0)], "big").columns == ["id", "name", "score", "raw", "anything", "_path", "_rowid"]


def test_columns_and_filters_reach_the_database(spark, database):
    reader = sqlite.PushingReader({"files": json.dumps([[database, 0]]), "table": "big"}, StructType.fromDDL("id long, name string, score double, anything long"))
    assert list(reader.pushFilters([EqualTo(("name",), "n5"), GreaterThan(("score",), 1.0), In(("id",), (15, 18)), IsNotNull(("name",))])) != []
    parts = reader.partitions()
    query, _ = reader.query(parts[0])
    assert '"raw"' not in query and query.count("?") == 6
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 1
    rows = sqlite.scan(spark, [(database, 0)], "big", "id long, name string, anything long").filter("name = 'n5' or name is null").filter("id < 100")
    assert sorted(tuple(r) for r in rows.collect()) == [(0, None, 0), (15, "n5", 5), (21, None, 7), (42, None, 14), (63, None, 21), (84, None, 28)]


def test_values_of_other_storage_classes_pass_filters(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("create table t (a)")
        db.executemany("insert into t values (?)", [("5",), (5,), (5.0,), (b"5",), ("x",), (None,)])
    rows = sqlite.scan(spark, [(path, 0)], "t", "a long")
    assert rows.filter("a = 5").count() == 4 and rows.filter("a is null").count() == 2 and rows.filter("a > 4").count() == 4


def test_tables_without_row_ids_sparse_ids_and_damage(spark, database, tmp_path):
    assert [tuple(r) for r in sqlite.scan(spark, [(database, 0)], "small", "k string, v string, _rowid long").collect()] == [("a", "x", 1), ("b", "1", 2)]
    sparse = str(tmp_path / "s.db")
    with sqlite3.connect(sparse) as db:
        db.execute("create table t (id integer primary key, rowid text)")
        db.executemany("insert into t values (?, ?)", [(1, "p"), (10**15, "q")])
    with sqlite3.connect(sparse) as db:
        assert len(sqlite.ranges_of(db, sqlite.find_table(db, "t"))) <= 1
    bad = tmp_path / "bad.db"
    bad.write_bytes(b"SQLite format 3\0" + b"x" * 5000)
    got = sqlite.scan(spark, [(sparse, 0), (str(bad), 0), (str(tmp_path / "none.db"), 0)], "t", "rowid string, _rowid long, _data string, _table string").collect()
    assert sorted(tuple(r) for r in got) == [("p", 1, '{"id": 1, "rowid": "p"}', "t"), ("q", 10**15, '{"id": 1000000000000000, "rowid": "q"}', "t")]
    assert sqlite.scan(spark, [], "t", "a long").collect() == []


def test_tail_reads_no_more_than_asked(spark, tmp_path):
    big, small, none = tmp_path / "big.jsonl", tmp_path / "small.jsonl", tmp_path / "none.jsonl"
    with open(big, "wb") as f:
        f.truncate(50 << 30)  # a hole of 50 GB: reading it whole would never end
        f.seek(0, 2)
        f.write(b"\n" + b"".join(b'{"i": %d}\r\n' % i for i in range(1000)) + b"\n")
    small.write_text("a\n\nb\nlast")
    got = spark.createDataFrame(tail.read_tail(spark, [str(big), str(small), f"file://{small}", str(none)], 101).collect()).groupBy("path").agg(F.collect_list("value").alias("v"), F.max("line_no").alias("n"))
    lines = {r.path: (r.v, r.n) for r in got.collect()}
    assert lines == {str(big): ([f'{{"i": {i}}}' for i in range(992, 1000)], 8), str(small): (["a", "b", "last"], 3), f"file://{small}": (["a", "b", "last"], 3)}
    assert tail.last_lines(str(small), 4)[1] == ["last"] and tail.last_lines(str(small), 3)[1] == [] and tail.last_lines(str(none), 3) == (None, [])


def test_line_numbers_of_split_files(spark, tmp_path):
    rng = range(4000)
    for name in ("a.jsonl", "in/b.jsonl"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join("" if i % 11 == 0 else "{broken" if i % 5 == 0 else json.dumps({"i": i}) for i in rng))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = files.read_lines(spark, [str(tmp_path)])
        assert lines.select("value").rdd.getNumPartitions() > 8
        plain, parsed = lines.collect(), files.read_json_lines(spark, [str(tmp_path)]).select("path", "line_no", F.try_variant_get("row", "$.i", "int").alias("i")).collect()
        text = lines._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    some = [i for i in rng if i % 11]
    for name in ("/a.jsonl", "/in/b.jsonl"):
        got = sorted((r.line_no, r.value) for r in plain if r.path.endswith(name))
        assert [n for n, _ in got] == list(range(1, len(some) + 1)) and all(f'"i": {i}' in v for (_, v), i in zip(got, some, strict=True) if i % 5)
        good = [i for i in some if i % 5]
        assert sorted((r.line_no, r.i) for r in parsed if r.path.endswith(name)) == list(enumerate(good, 1))
    window = text.index("Window")
    assert "value" not in text[window : text.index("\n", window)]


def test_index_names_files_elsewhere(spark, tmp_path):
    (tmp_path / "home").mkdir()
    for f in ("home/a.jsonl", "far.jsonl", "home/c.jsonl"):
        (tmp_path / f).write_text(f'{{"f": "{f}"}}\n\n{{"g": 1}}\n')
    (tmp_path / "home/sessions.json").write_text(json.dumps({"x": {"sessionFile": "a.jsonl"}, "y": [str(tmp_path / "far.jsonl"), "gone.jsonl"]}))
    got = hot.follow_index(spark, [str(tmp_path / "home")]).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.line_no) for r in got) == [("a.jsonl", 1), ("a.jsonl", 2), ("far.jsonl", 1), ("far.jsonl", 2)]


def _rollout(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def _at(second, kind, **payload):
    return {"timestamp": f"2026-08-02T05:43:{second:02d}.000Z", "type": kind, "payload": payload}


def _talk(start=0, answer="hi there", model="kimi-k3", info=None):
    return [
        _at(start, "session_meta", session_id="s1", cwd="C:\\Dev\\Proxy", model=model),
        _at(start + 1, "event_msg", type="task_started"),
        _at(start + 2, "response_item", type="message", role="user", content=[{"type": "input_text", "text": "hello world"}]),
        _at(start + 3, "event_msg", type="token_count", info=info),
        _at(start + 4, "response_item", type="message", role="assistant", content=[{"type": "output_text", "text": answer}]),
        _at(start + 5, "response_item", type="function_call_output", output="12345678"),
        _at(start + 6, "event_msg", type="task_complete"),
    ]


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    h = tmp_path_factory.mktemp("codex")
    far = h / "elsewhere/rollout-far"
    _rollout(h / ".codex/sessions/2026/08/rollout-proxy.jsonl", *_talk())
    _rollout(h / ".codex/sessions/rollout-text.jsonl", *_talk(20, answer="x" * 41))
    total = lambda i, o: _at(40, "event_msg", type="token_count", info={"total_token_usage": {"input_tokens": i, "output_tokens": o}})
    _rollout(h / ".codex/sessions/rollout-real.jsonl", total(100, 25), total(150, 40))
    _rollout(h / ".codex/sessions/whole.jsonl", _at(50, "session_meta", model="glm-5"), _at(52, "event_msg", type="other"))
    _rollout(h / ".codex/fixtures/noise.jsonl", total(9, 9))
    _rollout(far, {"type": "message", "timestamp": "2026-08-02T06:00:00Z", "response": {"usage": {"input_tokens": 7, "output_tokens": 1}}})
    call = lambda i, s, model, **k: {"id": i, "timestamp": f"2026-08-02T05:43:{s:02d}.000Z", "model": model, "promptTokens": 1200, "completionTokens": 40, "cost": 0.012} | k
    _rollout(h / ".litellm/usage-history.jsonl", call("r1", 4, "openai/Kimi-k3"), call("r1", 4, "openai/Kimi-k3"), call("r2", 4, "other"), call("r3", 51, "glm-5-air", cost=0), call("r4", 59, "kimi-k3"))
    with sqlite3.connect(h / ".codex/state_5.sqlite") as db:
        db.execute("create table threads_v2 (ID text, tokensUsed int, model text, cwd text, rolloutPath text, updated_at_ms int)")
        db.execute("create table thread_tools (ID text, tokensUsed int)")
        db.execute("insert into thread_tools values ('no', 5)")
        real, gone = str(h / ".codex/sessions/rollout-real.jsonl"), str(h / "gone.jsonl")
        db.executemany("insert into threads_v2 values (?, ?, ?, ?, ?, ?)", [("t1", 190, "m", "/w", real, 1785650000000), ("t2", 500, None, None, gone, 1785650000), ("t3", 70, "m", "/w", f"\\\\?\\{far}", 0), ("t4", 0, "m", "/w", None, 0), ("t5", 30, "m", "/w", " ", 0)])
    return str(h)


@pytest.fixture(autouse=True)
def tests_live_in_tmp(monkeypatch):
    monkeypatch.setattr(files, "NOISE", files.NOISE.replace("|tmp|", "|"))


def test_rollouts(spark, home):
    got = sorted(((r.model, r.input_tokens, r.output_tokens, bool(r.estimated), r.workspace, r.source_path.split(home)[-1].rsplit("/", 1)[-1], r.estimated_cost) for r in read_agent(spark, "codex", [home]).collect()), key=str)
    proxy = [r for r in got if "via" in (r[4] or "")]
    assert proxy == [("glm-5-air", 1200, 40, False, "via:tokenrouter", "usage-history.jsonl", None), ("openai/Kimi-k3", 1200, 40, False, "C:\\Dev\\Proxy · via:tokenrouter", "usage-history.jsonl", 0.012)]
    rest = [r[:5] for r in got if r not in proxy]
    want = [("kimi-k3", 5, 11, True, "C:\\Dev\\Proxy"), (None, 100, 25, False, None), (None, 150, 40, False, None), (None, 7, 1, False, None), ("codex", 500, 0, True, None), ("m", 30, 0, True, "/w")]
    assert sorted(rest, key=str) == sorted(want, key=str)


def test_threads(spark, home):
    rows = {r.thread: r for r in rollouts.thread_rows(spark, [f"{home}/.codex"]).collect()}
    assert set(rows) == {"t1", "t2", "t3", "t4", "t5"}
    assert rows["t2"].ts == rows["t1"].ts and rows["t3"].rollout.startswith("/") and rows["t5"].rollout is None
    ids = [r.id for r in read_agent(spark, "codex", [home]).collect()]
    assert len(set(ids)) == len(ids)


def test_no_rollouts(spark, tmp_path):
    assert read_agent(spark, "codex", [str(tmp_path)]).collect() == []


def test_arrow_types(database):
    reader = sqlite.SqliteReader({"files": json.dumps([[database, 7]]), "table": "big"}, StructType.fromDDL("raw binary, score double, anything string, _mtime timestamp, _path string, missing string"))
    batch = next(reader.read(reader.partitions()[0]))
    assert batch.schema.field("raw").type in (pa.binary(), pa.large_binary()) and batch.column("missing").null_count == batch.num_rows
    assert batch.slice(0, 2).to_pydict()["anything"] == ["0", "1"]


def _update(second, kind, session="s", **more):
    meta = {"_meta": more.pop("meta")} if "meta" in more else {}
    return {"timestamp": 1784180000 + second, "method": "x", "params": {"sessionId": session, "update": {"sessionUpdate": kind, **more}, **meta}}


@pytest.fixture(scope="module")
def streams_home(tmp_path_factory):
    h = tmp_path_factory.mktemp("grok") / ".grok/sessions"

    def summary(name, **more):
        (h / name).mkdir(parents=True, exist_ok=True)
        (h / name / "summary.json").write_text(json.dumps({"info": {"id": name.split("/")[-1], "cwd": "/w"}, "current_model_id": "grok-x", "updated_at": "2026-07-16T10:00:00.000Z"} | more))

    chunk = lambda text, p, total, cached: _update(0, "agent_message_chunk", content={"type": "text", "text": text}, meta={"totalTokens": total, "cachedReadTokens": cached, "promptId": p})
    summary("p/silent")
    _rollout(h / "p/silent/updates.jsonl", chunk("hi", "p1", 50_000, 40_000), _update(1, "turn_completed", prompt_id="p1"), chunk("later", "p1", 90_000, 1))
    summary("p/going")
    _rollout(h / "p/going/updates.jsonl", chunk("12345678", "a", 100, 0), _update(2, "turn_completed", prompt_id="b", usage={"inputTokens": 9, "outputTokens": 1, "modelUsage": {"m1": {"totalTokens": 3}, "m2": {"totalTokens": 7}}}), _update(3, "tool_call", rawInput={"q": 1}, meta={"promptId": "a"}), _update(3, "tool_call_update", rawInput="x" * 99, meta={"promptId": "a"}))
    _rollout(h / "%2Fenc/floor/updates.jsonl", _update(0, "other", meta={"totalTokens": 70, "cached_tokens": 20}))
    summary("p/stated", usage={"input_tokens": 30, "cached_tokens": 10, "output_tokens": 2, "costUsdTicks": 5_000_000_000})
    _rollout(h / "p/stated/chat_history.jsonl", {"type": "user", "content": "never counted"})
    summary("p/chat")
    _rollout(h / "p/chat/chat_history.jsonl", {"type": "user", "content": "hello world test"}, {"type": "user", "synthetic_reason": "r", "content": "x" * 10_000}, {"type": "assistant", "content": [{"text": "hi there friend"}]}, {"type": "note", "content": "y" * 99})
    _rollout(h / "p/asked/chat_history.jsonl", {"role": "user", "content": "12345"})
    return str(h.parents[1])


def test_streams(spark, streams_home):
    rows = read_agent(spark, "grok", [streams_home]).collect()
    got = sorted((r.source_path.split("/sessions/")[1], r.model, r.input_tokens, r.output_tokens, r.cache_read_tokens, bool(r.estimated), r.workspace, r.estimated_cost) for r in rows)
    assert got == [
        ("%2Fenc/floor/updates.jsonl", "grok-4.5", 50, 0, 20, True, "/enc", None),
        ("p/asked/chat_history.jsonl", "grok-4.5", 2, 0, 0, True, None, None),
        ("p/chat/chat_history.jsonl", "grok-x", 2504, 4, 0, True, "/w", None),
        ("p/going/updates.jsonl", "grok-x", 100, 4, 0, True, "/w", None),
        ("p/going/updates.jsonl", "m2", 9, 1, 0, False, "/w", None),
        ("p/silent/updates.jsonl", "grok-x", 10_000, 1, 40_000, True, "/w", None),
        ("p/stated/summary.json", "grok-x", 20, 2, 10, False, "/w", 0.5),
    ]
    assert len({r.id for r in rows}) == len(rows)
    times = {r.source_path.split("/")[-2] + str(r.estimated): r.ts.isoformat() for r in rows}
    assert times["silentTrue"].endswith("05:33:21") and times["goingTrue"] == times["goingFalse"] and times["chatTrue"].endswith("10:00:00")


def test_windsurf_stores_and_artifacts(spark, tmp_path):
    root = tmp_path / ".codeium/windsurf"
    (root / "User/globalStorage").mkdir(parents=True)
    with sqlite3.connect(root / "User/globalStorage/state.vscdb") as db:
        db.execute("create table ItemTable (key text primary key, value blob)")
        deep = {"a": [{"b": {"c": [{"usage": {"input_tokens": 5, "output_tokens": 1}, "model": "m1"}]}}]}
        db.executemany("insert into ItemTable values (?, ?)", [("chat.usage", json.dumps(deep).encode()), ("window.size", '{"input_tokens": 9}'), ("cascade.x", "no json")])
        db.execute("create table costs (id integer primary key, token_total int, prompt_tokens int, model text)")
        db.execute("insert into costs values (1, 3, 3, 'm2')")
        db.execute("create table plain (a text)")
    (root / "chat-1.json").write_text(json.dumps({"messages": [{"tokenUsage": {"input": 2, "output": 1}, "model": "m3"}]}))
    (root / "other.json").write_text(json.dumps({"usage": {"input_tokens": 50}}))
    got = sorted((r.model, r.input_tokens, r.output_tokens) for r in read_agent(spark, "windsurf", [str(tmp_path)]).collect())
    assert got == [("m1", 5, 1), ("m2", 3, 0), ("m3", 2, 1)]


def test_cut_exports(spark, tmp_path):
    from meterlake import store
    from meterlake.functions.salvage import outer_objects
    from meterlake.sources.exports import read_export

    row = lambda i, **k: {"id": f"e{i}", "agent": "amp", "model": "m", "timestamp": "2026-07-15T00:00:00.000Z", "inputTokens": i, "outputTokens": 1, "note": "} { \\\" "} | k
    whole = json.dumps([row(i) for i in range(5)])
    (tmp_path / "whole.json").write_text(json.dumps({"events": json.loads(whole)}))
    (tmp_path / "cut.json").write_text(whole[:-20])
    got = sorted((r.id, r.input_tokens, r.source_path) for r in read_export(spark, [str(tmp_path)], r"cut\.json$").collect())
    assert [g[0] for g in got] == ["e0", "e1", "e2", "e3"] and read_export(spark, [str(tmp_path)], "whole").count() == 5
    assert list(outer_objects('x{"a":{}} {bad} {"b":"\\u007d"')) == ['{"a":{}}'] and list(outer_objects(None)) == list(outer_objects('"{')) == []
    (tmp_path / "old.json").write_text(json.dumps([row(9), row(1, inputTokens=50)]))
    best = store.load_history(spark, str(tmp_path / "none"), archives=[str(tmp_path / "cut.json"), str(tmp_path / "whole.json")], legacy=[str(tmp_path / "old.json")])
    assert {r.id: r.input_tokens for r in best.collect()} == {"e0": 0, "e1": 50, "e2": 2, "e3": 3, "e4": 4, "e9": 9}
    assert store.load_history(spark, str(tmp_path / "none")).collect() == []
