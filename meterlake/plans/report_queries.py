"""Reports, rates of requests, and lists of recent rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import rates as R
from ..operators import activity, reports
from ..sources.connectors import CONNECTORS, agents_table
from .adapter import E_SQL, NOW, NOW_SQL, PARTS, REQ, norm_sql, priced, rated_usage, raw_usage, usage
from .queries import query

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
AT_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts"
SUMS = f"""CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(coalesce(estimated_cost, 0)), 9) AS estimated_cost,
  round(sum(input_cost), 9) AS input_cost, round(sum(cache_cost), 9) AS cache_cost, round(sum(output_cost), 9) AS output_cost, CAST(sum({REQ}) AS BIGINT) AS event_count"""
MODEL_KEY = f"lower(coalesce({norm_sql('model')}, 'unknown (' || agent || ')'))"
GROUP_SQL = {"agent": "agent", "model": MODEL_KEY, "day": "coalesce(strftime(ts, '%Y-%m-%d'), 'unknown')", "hour": "coalesce(strftime(ts, '%Y-%m-%dT%H:00'), 'unknown')"}


def at():
    """The time as text."""
    return F.date_format("ts", STAMP).alias("ts")


def _stats_sql(by: str) -> str:
    return f"WITH {E_SQL}, {PARTS} SELECT {GROUP_SQL[by]} AS key, {SUMS} FROM parts GROUP BY 1"


@query(_stats_sql("agent"))
def stats_by_agent(spark, sf_dir):
    return reports.stats(rated_usage(spark, sf_dir), R.rates(spark), "agent")


@query(_stats_sql("model"))
def stats_by_model(spark, sf_dir):
    return reports.stats(rated_usage(spark, sf_dir), R.rates(spark), "model")


@query(_stats_sql("day"))
def stats_by_day(spark, sf_dir):
    return reports.stats(rated_usage(spark, sf_dir), R.rates(spark), "day", sort="tokens")


@query(_stats_sql("hour"))
def stats_by_hour(spark, sf_dir):
    return reports.stats(rated_usage(spark, sf_dir), R.rates(spark), "hour")


@query(f"WITH {E_SQL}, {PARTS} SELECT agent AS key, {SUMS}, CAST(grouping(agent) AS INT) AS is_total FROM parts GROUP BY GROUPING SETS ((agent), ())")
def stats_with_total(spark, sf_dir):
    return reports.stats_with_total(rated_usage(spark, sf_dir), R.rates(spark))


def _cost_sql(by: str, share: bool = True, limit: str = "") -> str:
    last = ", round(c / CASE WHEN sum(c) OVER () = 0 THEN 1 ELSE sum(c) OVER () END, 9) AS share" if share else ""
    return f"WITH {E_SQL}, s AS (SELECT {GROUP_SQL[by]} AS {by}, sum(coalesce(estimated_cost, 0)) AS c, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM e GROUP BY 1) SELECT {by}, round(c, 9) AS estimated_cost, total_tokens{last} FROM s {limit}"


@query(_cost_sql("agent"))
def cost_report_agent(spark, sf_dir):
    return reports.cost_report(usage(spark, sf_dir), "agent")


@query(_cost_sql("model"))
def cost_report_model(spark, sf_dir):
    return reports.cost_report(usage(spark, sf_dir), "model")


@query(_cost_sql("model", False, "ORDER BY estimated_cost DESC, model LIMIT 15"))
def top_models(spark, sf_dir):
    return reports.top_models(usage(spark, sf_dir))


_PERIODS = " UNION ALL ".join(f"SELECT '{p}' AS period, {s} AS since" for p, s in {"today": NOW_SQL, "24h": f"{NOW_SQL} - INTERVAL 24 HOUR", "7d": f"{NOW_SQL} - INTERVAL 7 DAY", "30d": f"{NOW_SQL} - INTERVAL 30 DAY", "all": "TIMESTAMP '0001-01-01'"}.items())


@query(
    f"""WITH {E_SQL}, {PARTS}, p AS ({_PERIODS}), x AS (SELECT p.period, parts.*, {MODEL_KEY} AS m FROM parts JOIN p ON ts >= p.since)
SELECT period, CASE WHEN grouping(m) = 0 THEN 'model' WHEN grouping(agent) = 0 THEN 'agent' ELSE 'total' END AS dim, coalesce(m, agent) AS key, {SUMS} FROM x GROUP BY GROUPING SETS ((period), (period, m), (period, agent))"""
)
def period_stats(spark, sf_dir):
    return reports.period_stats(rated_usage(spark, sf_dir), R.rates(spark), NOW)


@query(f"WITH {E_SQL} SELECT id, agent, {AT_SQL}, total_tokens FROM e WHERE ts >= {NOW_SQL} - INTERVAL 7 DAY AND ts <= {NOW_SQL} - INTERVAL 1 DAY")
def period_filter(spark, sf_dir):
    rows = reports.in_period(usage(spark, sf_dir), NOW - timedelta(days=7), NOW - timedelta(days=1))
    return rows.select("id", "agent", at(), "total_tokens")


_RECENT = "SELECT id, agent, model, {at}, total_tokens, round(estimated_cost, 9) AS estimated_cost FROM e {where} ORDER BY e.ts DESC, id LIMIT {n}"


@query(f"WITH {E_SQL} " + _RECENT.format(at=AT_SQL, where="", n=100))
def recent_events(spark, sf_dir):
    return priced(spark, reports.recent(raw_usage(spark, sf_dir))).select("id", "agent", "model", at(), "total_tokens", F.round("estimated_cost", 9).alias("estimated_cost"))


@query(f"WITH {E_SQL} " + _RECENT.format(at=AT_SQL, where="WHERE agent = 'grok'", n=1000))
def recent_events_agent(spark, sf_dir):
    return priced(spark, reports.recent(raw_usage(spark, sf_dir), 5000, "grok")).select("id", "agent", "model", at(), "total_tokens", F.round("estimated_cost", 9).alias("estimated_cost"))


LIVE_SQL = "ts IS NOT NULL AND coalesce(request_count, 0) <= 5 AND (NOT estimated OR (coalesce(request_count, 0) <= 1 AND total_tokens <= 2000000 AND (total_tokens > 0 OR coalesce(estimated_cost, 0) > 0)))"


@query(f"WITH {E_SQL} SELECT id, agent, estimated, request_count FROM e WHERE {LIVE_SQL}")
def live_rows(spark, sf_dir):
    return usage(spark, sf_dir).filter(reports.is_live()).select("id", "agent", "estimated", "request_count")


@query(
    f"""WITH {E_SQL}, u AS (SELECT *, 0 AS hot FROM e WHERE seq % 3 <> 0 UNION ALL SELECT *, 1 AS hot FROM e WHERE seq % 3 <> 1),
d AS (SELECT *, row_number() OVER (PARTITION BY agent, date_trunc('second', ts), coalesce(model, ''), input_tokens, output_tokens ORDER BY hot, CASE WHEN hot = 0 THEN -seq ELSE seq END) AS n FROM u WHERE {LIVE_SQL} AND ts >= {NOW_SQL} - INTERVAL 3 DAY)
SELECT id, agent, {AT_SQL}, total_tokens FROM d WHERE n = 1 ORDER BY d.ts DESC, id LIMIT 1000"""
)
def recent_live_events(spark, sf_dir):
    rows = usage(spark, sf_dir)
    out = reports.recent_live(rows.filter("seq % 3 <> 0"), rows.filter("seq % 3 <> 1"), 4000, NOW - timedelta(days=3))
    return out.select("id", "agent", at(), "total_tokens")


_STATUS = f"""agents AS (SELECT * FROM (VALUES {", ".join(f"('{c.agent}')" for c in CONNECTORS)}) v(agent)), st AS (SELECT a.agent, coalesce(count(e.id), 0) AS event_count, strftime(max(e.ts), '%Y-%m-%dT%H:%M:%S') AS last_event FROM agents a LEFT JOIN e ON e.agent = a.agent GROUP BY 1)"""
_LABEL = "CASE agent WHEN 'routerlab' THEN 'RouterLab' WHEN '9router' THEN '9Router' WHEN 'litellm' THEN 'LiteLLM' WHEN 'claude-code' THEN 'Claude Code' WHEN 'codex' THEN 'OpenAI Codex (App)' WHEN 'cursor' THEN 'Cursor' WHEN 'windsurf' THEN 'Windsurf' WHEN 'grok' THEN 'Grok (xAI)' WHEN 'hermes' THEN 'Hermes Agent' WHEN 'qwencoder' THEN 'QwenCoder Cloud' WHEN 'copilot' THEN 'GitHub Copilot' WHEN 'devin' THEN 'Devin' WHEN 'opencode' THEN 'OpenCode' WHEN 'antigravity' THEN 'Antigravity' ELSE agent END"


@query(f"WITH {E_SQL}, {_STATUS} SELECT agent, {_LABEL} AS label, event_count, last_event FROM st")
def agent_status(spark, sf_dir):
    return reports.agent_status(usage(spark, sf_dir), agents_table(spark).select("agent"))


@query(f"WITH {E_SQL}, {_STATUS} SELECT agent, {_LABEL} AS label, event_count, last_event FROM st ORDER BY event_count DESC, agent LIMIT 6")
def top_agents(spark, sf_dir):
    return reports.top_agents(usage(spark, sf_dir), agents_table(spark).select("agent"))


@query(f"WITH {E_SQL} SELECT count(DISTINCT CAST(floor(epoch_ms(ts) / 60000) AS BIGINT)) AS active_minutes, agent FROM e GROUP BY agent")
def active_minutes(spark, sf_dir):
    return usage(spark, sf_dir).groupBy("agent").agg(F.count_distinct(activity.minute(F.col("ts"))).alias("active_minutes"))


@query(f"WITH {E_SQL}, s AS (SELECT CAST(sum({REQ}) AS BIGINT) AS requests, count(DISTINCT CAST(floor(epoch_ms(ts) / 60000) AS BIGINT)) AS active_minutes FROM e) SELECT requests, active_minutes, round(requests / active_minutes, 9) AS rpm FROM s")
def active_rpm(spark, sf_dir):
    return activity.active_rpm(usage(spark, sf_dir))


_COUNTED = f"""c AS (SELECT *, CASE WHEN request_count > 0 AND request_count <= 100 THEN request_count ELSE 1 END AS n FROM e WHERE NOT estimated AND ts > {NOW_SQL} - INTERVAL 60 MINUTE AND ts <= {NOW_SQL} + INTERVAL 5 SECOND AND (total_tokens > 0 OR estimated_cost > 0))"""


@query(f"WITH {E_SQL}, {_COUNTED}, s AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS requests FROM c) SELECT CAST(60 AS INT) AS window_minutes, requests, round(requests / 3600 * 60, 9) AS rpm, round(requests / 3600, 9) AS rps FROM s")
def live_rate(spark, sf_dir):
    return activity.live_rate(usage(spark, sf_dir), NOW, 60)


@query(
    f"""WITH {E_SQL}, {_COUNTED}, s AS (SELECT least(59, greatest(0, floor((epoch_ms({NOW_SQL}) - epoch_ms(ts)) / 60000))) AS a, sum(n) AS n FROM c GROUP BY 1)
SELECT CAST(r.i AS INT) AS "offset", CAST(coalesce(s.n, 0) AS BIGINT) AS requests FROM range(60) r(i) LEFT JOIN s ON s.a = r.i"""
)
def per_minute_slots(spark, sf_dir):
    return activity.minute_slots(usage(spark, sf_dir), NOW, 60)


@query(f"WITH {E_SQL} SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at, CAST(greatest(0, round((epoch_ms({NOW_SQL}) - epoch_ms(max(ts))) / 1000.0)) AS BIGINT) AS age_seconds FROM e WHERE {LIVE_SQL} AND ts <= {NOW_SQL} + INTERVAL 5 SECOND")
def last_request(spark, sf_dir):
    return activity.last_request(usage(spark, sf_dir), NOW).withColumn("last_at", F.date_format("last_at", STAMP))


@query(f"WITH {E_SQL} SELECT id, agent, {AT_SQL}, CAST(sum({REQ}) OVER (PARTITION BY agent ORDER BY e.ts RANGE BETWEEN INTERVAL 3 MINUTE PRECEDING AND CURRENT ROW) AS BIGINT) AS window_requests FROM e WHERE NOT estimated")
def sliding_rate(spark, sf_dir):
    return activity.sliding_rate(usage(spark, sf_dir)).select("id", "agent", at(), "window_requests")


@query(
    f"""WITH {E_SQL} SELECT id, agent, input_tokens, CASE WHEN total_tokens = 0 THEN NULL ELSE total_tokens END AS given, total_tokens, request_count, estimated FROM e WHERE agent <> 'cursor'"""
)
def sanitize_events(spark, sf_dir):
    rows = usage(spark, sf_dir).withColumns({"given": F.nullif("total_tokens", F.lit(0)), "agent": F.when(F.col("agent") != "cursor", F.col("agent"))})
    return reports.sanitize(rows.withColumn("total_tokens", F.col("given"))).select("id", "agent", "input_tokens", "given", "total_tokens", "request_count", "estimated")


@query(f"WITH {E_SQL} SELECT id, total_tokens, request_count FROM e WHERE total_tokens > 0 OR (coalesce(estimated_cost, 0) > 0 AND {REQ} > 0)")
def drop_zero_probes(spark, sf_dir):
    return usage(spark, sf_dir).filter((F.col("total_tokens") > 0) | (F.coalesce("estimated_cost", F.lit(0.0)) > 0)).select("id", "total_tokens", "request_count")
