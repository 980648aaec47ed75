"""Expectations on small fixtures: rates, days, merges, sources."""

from __future__ import annotations

import json
import sqlite3
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from meterlake import store
from meterlake.functions import rates as R
from meterlake.functions import text, time, usage
from meterlake.operators import activity, dedup, merge, pricing, reports, router_days
from meterlake.schema import USAGE, conform

NOW = datetime(2026, 7, 20, tzinfo=timezone.utc)


def rows(spark, *parts):
    base = {"agent": "devin", "ts": datetime(2026, 7, 15), "input_tokens": 100, "output_tokens": 10, "cache_read_tokens": 0, "cache_write_tokens": 0, "estimated_cost": 1.0, "source_path": "/x", "estimated": False}
    out = []
    for i, p in enumerate(parts):
        r = base | {"seq": i, "id": f"e{i}"} | p
        r.setdefault("total_tokens", sum(r[c] for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")))
        out.append(tuple(r.get(f.name) for f in USAGE.fields))
    return spark.createDataFrame(out, USAGE)


def router(n, tokens, day=15, **more):
    return [{"agent": "9router", "ts": datetime(2026, 7, day, 1, i // 60, i % 60), "model": "m", "input_tokens": tokens, "output_tokens": 0, "estimated_cost": 0.0, "workspace": "w", **more} for i in range(n)]


def daily(tokens, requests, model="m", workspace="w", day=15, cost=0.0):
    return {"agent": "9router", "ts": datetime(2026, 7, day, 12), "model": model, "workspace": workspace, "estimated": True, "input_tokens": tokens, "output_tokens": 0, "request_count": requests, "estimated_cost": cost}


def test_prices(spark):
    df = rows(spark, {"model": "claude-sonnet-4", "input_tokens": 1_000_000, "output_tokens": 0}, {"model": "claude-sonnet-4", "input_tokens": 1_000_000, "output_tokens": 0, "cache_read_tokens": 1_000_000}, {"model": "nobody", "input_tokens": 10}, {"model": "grok-4.5", "input_tokens": 50_000, "output_tokens": 0, "cache_read_tokens": 200_000})
    got = {r.id: r for r in pricing.price_events(df, R.rates(spark)).collect()}
    assert got["e0"].estimated_cost == pytest.approx(3.0) and got["e0"].pricing_status == "priced"
    assert got["e1"].estimated_cost == pytest.approx(3.3)
    assert got["e2"].pricing_status == "unknown_model" and got["e2"].estimated_cost > 0
    assert got["e3"].estimated_cost == pytest.approx((50_000 * 4 + 200_000 * 0.6) / 1e6)
    parts = pricing.with_rates(df.filter("id = 'e1'"), R.rates(spark)).select(*[c.alias(n) for n, c in pricing.cost_parts(F.lit(6.6)).items()]).first()
    assert (parts.input_cost, parts.cache_cost) == (pytest.approx(6.0), pytest.approx(0.6))


def test_request_counts_and_active_minutes(spark):
    at = datetime(2026, 7, 15, 10)
    df = rows(spark, {"ts": at, "request_count": 4}, {"ts": at + timedelta(seconds=30)}, {"ts": at + timedelta(minutes=5), "request_count": 5})
    got = activity.active_rpm(df).first()
    assert (got.requests, got.active_minutes, got.rpm) == (10, 2, 5.0)


def test_live_rate_and_slots(spark):
    ago = lambda m: (NOW - timedelta(minutes=m)).replace(tzinfo=None)
    df = rows(spark, {"ts": ago(0.5), "request_count": 2}, {"ts": ago(1.5), "request_count": 3}, {"ts": ago(2.5), "request_count": 1}, {"ts": ago(9)}, {"ts": ago(1), "estimated": True, "request_count": 500}, {"ts": ago(1), "input_tokens": 0, "output_tokens": 0, "estimated_cost": 0.0})
    got = activity.live_rate(df, NOW, 3).first()
    assert (got.requests, got.rpm) == (6, 2.0)
    assert [(r.offset, r.requests) for r in activity.minute_slots(df, NOW, 3).collect()] == [(2, 1), (1, 3), (0, 2)]


def test_live_rows(spark):
    df = rows(spark, {}, {"estimated": True}, {"estimated": True, "request_count": 500}, {"estimated": True, "total_tokens": 51_000_000})
    assert [r.id for r in df.filter(reports.is_live()).orderBy("id").collect()] == ["e0", "e1"]


def test_richer_rows(spark):
    a = rows(spark, {"id": "x", "model": None, "estimated_cost": 9.0}, {"id": "y", "estimated": True, "total_tokens": 10**6}, {"id": "z"})
    b = rows(spark, {"id": "x", "model": "m"}, {"id": "y", "total_tokens": 5}, {"id": "z", "estimated_cost": 1.0, "source_path": "/later"})
    got = {r.id: r for r in dedup.richer_union(a, b).collect()}
    assert got["x"].model == "m" and got["y"].total_tokens == 5 and got["z"].source_path == "/x"


@pytest.mark.parametrize(
    ("days", "calls", "expect"),
    [
        ([daily(131_000_000, 2805)], router(50, 4_010_000), (1, 131_000_000)),
        ([daily(1_100, 1)], router(1, 73_000), (1, 73_000)),
        ([daily(5_020_000, 99)], router(25, 100_050), (26, 5_020_000)),
        ([daily(50_000, 1, cost=1.0)], router(34, 0) + router(1, 40_000), (1, 50_000)),
        ([daily(10_000, 5), daily(10_000, 5, model="mixed", workspace="")], [], (1, 10_000)),
    ],
)
def test_router_days(spark, days, calls, expect):
    got = router_days.collapse_router_days(rows(spark, *days, *calls)).agg(F.count(F.lit(1)), F.sum("total_tokens")).first()
    assert tuple(got) == expect


def test_monotonic_days(spark):
    old = rows(spark, *[{"id": f"o{i}"} for i in range(5)])
    new = rows(spark, {"id": "n0"}, {"id": "n1", "ts": datetime(2026, 7, 16)})
    assert sorted(r.id for r in merge.monotonic_merge(old, new).collect()) == ["n1", "o0", "o1", "o2", "o3", "o4"]
    assert merge.monotonic_merge(old.limit(0), new.limit(0)).count() == 0


def test_stale_residuals(spark):
    ghost = {"agent": "grok", "estimated": True, "output_tokens": 0, "source_path": "/a/updates.jsonl"}
    df = rows(spark, {"agent": "grok", "source_path": "/a/updates.jsonl"}, ghost, ghost, ghost | {"estimated": True, "output_tokens": 5}, ghost | {"source_path": "/b/updates.jsonl"})
    assert sorted(r.id for r in dedup.drop_stale_residuals(df).collect()) == ["e0", "e3", "e4"]


def test_rollups_keep_totals(spark):
    df = rows(spark, *[{"ts": (NOW - timedelta(hours=7 * i)).replace(tzinfo=None), "model": "A (x)" if i % 2 else "a", "estimated_cost": 0.1 * i} for i in range(60)])
    made = merge.tiered_rollup(df, NOW, " my host!")
    for since in ("24h", "7d", "30d"):
        sums = lambda d, s=since: d.filter(F.col("ts") >= time.moment(time.since(s, NOW))).agg(F.sum("total_tokens"), F.sum("estimated_cost")).first()
        a, b = sums(df), sums(made)
        assert a[0] == b[0] and a[1] == pytest.approx(b[1])
    assert [r.machine for r in merge.machines(made).collect()] == ["my-host"]
    assert merge.merge_local_over_rollups(df, made, "my host").count() == merge.heal(df).count()


def test_names(spark):
    names = ["gpt-5.5 (a (b))", "openai/gpt-5.5|x", "  ", "Deep_Seek-v4-flash", "x/models", "DIGIGO", "a  b-_"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(text.normalize_model(F.col("n"))).collect()]
    assert got == ["gpt-5.5 (a (b))", "gpt-5.5", None, "deepseek-v4-flash", "x/models", "Digigo", "a b"]


def test_times():
    assert time.since("90m", NOW) == NOW - timedelta(minutes=90)
    assert time.since("today", NOW + timedelta(hours=1), "Asia/Tokyo") == NOW - timedelta(hours=9)
    assert time.since("yesterday", NOW + timedelta(hours=1)) == NOW - timedelta(days=1)
    assert time.since("nonsense", NOW) is None and time.since(None, NOW) is None


def test_buckets(spark):
    docs = [{"usage": {"prompt_tokens": 3, "completion_tokens": 4}}, {"metadata": {"metrics": {"input_tokens": 100, "output_tokens": 20, "cache_read_tokens": 50}}}, {"prompt_tokens": 1000, "prompt_tokens_details": {"cached_tokens": 400}}, {"input_tokens": "abc", "input": 5}, {}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string").withColumn("v", F.parse_json("t"))
    got = {r.i: tuple(r.b) for r in usage.with_buckets(df, F.col("v")).collect()}
    assert got == {0: (3, 4, 0, 0), 1: (100, 20, 50, 0), 2: (1000, 0, 400, 0)}


def test_generic_files(spark, tmp_path):
    from meterlake.sources import connectors, generic

    logs = tmp_path / ".amp" / "a b"
    logs.mkdir(parents=True)
    (logs / "s.jsonl").write_text('{"usage": {"input_tokens": 5, "output_tokens": 1}, "model": "x/kimi-k3", "cwd": "/w", "timestamp": "2026-07-15T00:00:00Z"}\nbroken\n\n{"usage": {}}\n')
    (logs / "d.json").write_text(json.dumps({"messages": [{"input_tokens": 7, "ts": 1_784_000_000}]}))
    (tmp_path / ".amp" / "node_modules").mkdir()
    (tmp_path / ".amp" / "node_modules" / "n.jsonl").write_text('{"input_tokens": 1}\n')
    got = sorted((r.input_tokens, r.model, r.workspace) for r in connectors.read_agent(spark, "amp", [str(tmp_path)]).collect())
    assert got == [(5, "kimi-k3", "/w"), (7, None, None)]
    assert generic.read_usage(spark, [str(tmp_path / "none")], "amp").count() == 0
    assert len(connectors.CONNECTORS) == 51


def test_sqlite(spark, tmp_path):
    from meterlake.sources import sqlite

    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("create table t (id integer, v text)")
        db.executemany("insert into t values (?, ?)", [(1, "x"), (2, None)])
    (tmp_path / "bad.db").write_bytes(b"not a database")
    got = [json.loads(r.data) for r in sqlite.read_tables(spark, [str(tmp_path)], {"t": "id", "absent": None}).orderBy("line_no").collect()]
    assert got == [{"id": 2, "v": None}, {"id": 1, "v": "x"}]


def test_snapshot(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert store.read_snapshot(spark, path).count() == 0
    store.write_snapshot(rows(spark, {}, {}), path)
    store.write_snapshot(rows(spark, {}, {}, {"ts": None}), path)
    assert store.read_snapshot(spark, path).count() == 3 and store.read_snapshot(spark, f"{path}.bak").count() == 2
    assert store.better((100, 10), (40, 99)) and store.better((5, 100), (6, 10)) and not store.better((1, 1), (2, 2))


def test_conform_and_empty(spark):
    none = conform(spark.createDataFrame([], "id string, extra int"))
    assert none.columns == USAGE.fieldNames() and reports.stats(none, R.rates(spark)).count() == 0


def test_rows_without_stale_residuals_spread(spark):
    """Rows that meet no session file don't all go to one task of the join."""
    from meterlake.operators.dedup import drop_stale_residuals
    from meterlake.schema import conform

    some = spark.range(4000).selectExpr("id as seq", "concat('r', id) as id", "if(id % 10 = 0, 'grok', 'amp') as agent", "if(id % 10 = 0, '/s/updates.jsonl', '/a') as source_path", "true as estimated", "0L as output_tokens", "id as total_tokens")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    had = {k: spark.conf.get(k) for k in conf}
    try:
        [spark.conf.set(k, v) for k, v in conf.items()]
        parts = [r["count"] for r in drop_stale_residuals(conform(some)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        [spark.conf.set(k, v) for k, v in had.items()]
    assert sum(parts) == 3601 and max(parts) < 2000


def test_a_model_name_is_worked_out_once(spark):
    from meterlake.functions.text import normalize_model

    plan = spark.range(1).select(normalize_model(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 50
    names = [("a/b (x)", "a/b"), ("deep_seek-v3", "deepseek-v3"), ("gpt-4.1", "gpt-4.1"), ("openai/gpt-4.1 (k)|p", "gpt-4.1 (k)"), ("openai/gpt-4.1 [k]", "gpt-4.1"), (" DIGIGO", "Digigo"), ("models/v1", "models/v1"), ("a-", "a"), ("--", None), ("x\n", "x")]
    got = spark.createDataFrame(names, "m string, want string").select("m", "want", normalize_model(F.col("m")).alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []


def test_rollups_sum_by_written_names_first(spark):
    """Names that are normalized alike meet in one rollup, rows without a name in another; names are worked out over sums, not rows."""
    names = ["GLM-5.1|a", "glm-5.1 (b)", "GLM-5.1|a", None]
    made = spark.createDataFrame([(i, f"e{i}", "grok", m, 10 + i, 0.5) for i, m in enumerate(names)], "seq long, id string, agent string, model string, total_tokens long, estimated_cost double")
    rows = conform(made.withColumn("ts", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(3), F.lit(4), F.lit(5), F.lit(6))))
    out = merge.tiered_rollup(rows, datetime(2024, 1, 31, tzinfo=timezone.utc), "m")
    assert {(r.model, r.total_tokens, r.estimated_cost) for r in out.collect()} == {("glm-5.1", 33, 1.5), (None, 13, 0.5)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2
