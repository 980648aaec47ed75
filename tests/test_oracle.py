"""Some queries against their SQL on the small tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["stats_by_model", "period_stats", "price_events", "collapse_router_days", "reconcile_daily", "monotonic_merge", "generic_usage_scan", "sliding_rate", "recent_events", "recent_events_agent", "synthetic_ts", "uncached_split", "cost_ticks", "reasoning_policy", "agent_labels", "message_contents", "alias_override", "proxy_claims", "hot_rows", "spend_by_model", "thread_replacement", "conversation_models", "export_period_stats"]


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if v is None or v != v else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    assert plain(entry.queries()[name](spark, SF).toPandas()) == plain(db.execute(entry.oracle_sql()[name]).fetchdf())


def test_router_rows_state_costs_of_nothing(spark, tmp_path):
    """Costs of 0, also of requests without tokens, are those of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"create table events as select event_id, ts, event_id % 2 as user_id, event_type, case when event_id % 3 = 0 then 0.0 else value end as value, '{{\"k\": 0}}' as props from '{SF}/events.parquet' limit 200")
    db.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = entry.queries()["router_rows"](spark, str(tmp_path)).toPandas()
    assert (got["router_cost"] == 0).any() and plain(got) == plain(db.execute(entry.oracle_sql()["router_rows"]).fetchdf())


def test_key_value_stores_grow_in_number(spark, monkeypatch):
    """More rows are more stores, with the same usage."""
    duckdb = pytest.importorskip("duckdb")
    from meterlake.plans import reader_queries

    monkeypatch.setattr(reader_queries, "STORE_ROWS", 300)
    dealt, make = [], reader_queries._databases
    monkeypatch.setattr(reader_queries, "_databases", lambda rows, *a: (dealt.append(rows.rdd.getNumPartitions()), make(rows, *a)))
    got = entry.queries()["kv_usage"](spark, SF).toPandas()
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{SF}/events.parquet'")
    assert dealt == [2 + len(db.execute("select 1 from events").fetchall()) // 300]
    assert plain(got) == plain(db.execute(entry.oracle_sql()["kv_usage"]).fetchdf())


def test_day_documents_price_their_rows_once(spark, monkeypatch):
    """Requests and day documents come from one priced table; sums of requests are made once."""
    duckdb = pytest.importorskip("duckdb")
    from meterlake.plans import reconcile_queries as plans

    priced, usage = [], plans.usage
    monkeypatch.setattr(plans, "usage", lambda *a: (priced.append(a), usage(*a))[1])
    db = duckdb.connect()
    db.execute("set threads = 1")
    db.execute(f"create view events as select * from '{SF}/events.parquet'")
    assert plain(entry.queries()["reconcile_daily"](spark, SF).toPandas()) == plain(db.execute(entry.oracle_sql()["reconcile_daily"]).fetchdf())
    assert len(priced) == 1
    for name in ("expand_daily", "daily_map_merge"):  # share the documents
        assert plain(entry.queries()[name](spark, SF).toPandas()) == plain(db.execute(entry.oracle_sql()[name]).fetchdf())


def test_json_lines_are_parsed_once_a_pass(spark, tmp_path):
    """Two passes (numbers and rows) parse a line once each."""
    from meterlake.sources import files

    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{broken\n\nnull\n[2]\n')
    rows = files.read_json_lines(spark, [str(tmp_path)])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 2, plan
    assert [r.line_no for r in rows.select("line_no").orderBy("line_no").collect()] == [1, 2, 3]
