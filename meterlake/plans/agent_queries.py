"""Contents of messages, records of routers and attributes of sessions, drawn from the tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import content
from ..functions import rates as R
from ..functions.time import moment
from ..operators import logs, reports
from .adapter import E_SQL, NOW, NOW_SQL, RAW, REQ, raw_usage, table, usage
from .queries import query
from .report_queries import AT_SQL, at

# Contents of every shape: text, parts, objects under each name, numbers, nested lists, nothing.
_SHAPES = ["'\"' || role || '\"'", "'[{\"text\":\"' || role || '\"}, \"t' || turn || '\", {\"x\":1}, 7]'", "'{\"text\":\"' || role || '\", \"content\":\"no\"}'", "'{\"input_text\":\"in' || turn || '\"}'", "'{\"content\":\"c' || turn || '\"}'", "'12.5'", "'[\"a\", [\"' || role || '\", [true]], {\"k\":' || turn || '}]'", "'null'", "'[]'", "'not json'"]
_SHAPE = "CASE (turn + length(conv_id || '')) % 10 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SHAPES)) + " END"
_TEXTS = "CASE (turn + length(conv_id || '')) % 10 WHEN 0 THEN role WHEN 1 THEN role || 't' || turn WHEN 2 THEN role WHEN 6 THEN 'a' ELSE '' END"
_CHARS = "CASE (turn + length(conv_id || '')) % 10 WHEN 0 THEN length(role) WHEN 1 THEN length(role || 't' || turn) WHEN 2 THEN length(role) WHEN 3 THEN length('in' || turn) WHEN 4 THEN length('c' || turn) WHEN 5 THEN 4 WHEN 6 THEN 1 ELSE 0 END"
_RENDERED = "CASE (turn + length(conv_id || '')) % 10 WHEN 0 THEN role WHEN 1 THEN role || chr(10) || 't' || turn || chr(10) || '{\"x\":1}' || chr(10) || '7' WHEN 2 THEN role WHEN 3 THEN '{\"input_text\":\"in' || turn || '\"}' WHEN 4 THEN 'c' || turn WHEN 5 THEN '12.5' WHEN 6 THEN 'a' || chr(10) || role || chr(10) || 'true' || chr(10) || '{\"k\":' || turn || '}' ELSE '' END"


@query(f"SELECT conv_id, turn, {_TEXTS} AS message, CAST({_CHARS} AS BIGINT) AS chars, {_RENDERED} AS rendered FROM conversations")
def message_contents(spark, sf_dir):
    v = F.col("v")
    rows = table(spark, sf_dir, "conversations").withColumn("v", F.try_parse_json(F.expr(_SHAPE)))
    return rows.select("conv_id", "turn", content.message_text(v).alias("message"), content.message_chars(v).alias("chars"), content.render(v).alias("rendered"))


_GIVEN = "CASE user_id % 4 WHEN 0 THEN ' m' || user_id WHEN 1 THEN '' WHEN 2 THEN 'named' END"
_RESOLVED = "CASE event_id % 5 WHEN 0 THEN 'M' || user_id WHEN 1 THEN 'gpt-' || user_id WHEN 2 THEN ' longername' || user_id WHEN 3 THEN ' ' END"


@query(f"SELECT event_id, CASE WHEN regexp_matches(r, '[./-]') OR length(r) > 8 THEN r WHEN m <> '' THEN m ELSE nullif(r, '') END AS model FROM (SELECT event_id, trim({_GIVEN}) AS m, trim({_RESOLVED}) AS r FROM events)")
def pick_model(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", content.pick_model(F.expr(_GIVEN), F.expr(_RESOLVED)).alias("model"))


_ALIAS = "CASE user_id % 5 WHEN 0 THEN ' Hermes ' WHEN 1 THEN 'auto' WHEN 2 THEN '' WHEN 3 THEN 'kimi-k' || user_id END"
_CONFIG = "CASE event_id % 4 WHEN 0 THEN '{\"model\":\"cfg' || user_id || '\"}' WHEN 1 THEN '{\"model\":5}' WHEN 2 THEN 'broken{' END"


@query(f"""SELECT event_id, CASE WHEN coalesce(m, '') = '' OR lower(m) IN ('hermes', 'auto') THEN CASE WHEN event_id % 4 = 0 THEN 'cfg' || user_id ELSE nullif(m, '') END ELSE m END AS model FROM (SELECT event_id, user_id, trim({_ALIAS}) AS m FROM events)""")
def alias_override(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", content.concrete_model(F.expr(_ALIAS), F.expr(_CONFIG)).alias("model"))


_FOLDER = "CASE user_id % 5 WHEN 0 THEN '/h/sessions/C%3A%5CDev%5Cp' || user_id || '/s1' WHEN 1 THEN '/h/sessions/%2Fhome%2Fu' || user_id || '/s2' WHEN 2 THEN '/h/sessions/s' || user_id WHEN 3 THEN '/h/sessions/plain/s3' ELSE 'alone' END"


@query(r"SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'C:\Dev\p' || user_id WHEN 1 THEN '/home/u' || user_id END AS workspace FROM events")
def workspace_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", content.workspace_of(F.expr(_FOLDER)).alias("workspace"))


@query("""WITH s AS (SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN strlen(text) ELSE 0 END) AS BIGINT) AS p, CAST(sum(CASE WHEN role = 'user' THEN 0 ELSE strlen(text) END) AS BIGINT) AS g, count(*) FILTER (WHERE role = 'assistant' AND turn > 1) AS n, count(*) AS t FROM conversations GROUP BY 1)
SELECT conv_id, CAST(ceil(greatest(p, g) / 4.0) AS BIGINT) AS input_tokens, CAST(ceil(greatest(g, floor(p * 0.25::DOUBLE)) / 4.0) AS BIGINT) AS output_tokens, CAST(CASE WHEN n > 0 THEN n ELSE ceil(t / 4.0) END AS BIGINT) AS request_count FROM s""")  # fmt: skip
def conversation_estimate(spark, sf_dir):
    size, asked = F.octet_length("text"), F.col("role") == "user"
    c = table(spark, sf_dir, "conversations").withColumns({"p": F.when(asked, size).otherwise(0), "g": F.when(asked, 0).otherwise(size), "n": ((F.col("role") == "assistant") & (F.col("turn") > 1)).cast("int")})
    sums = c.groupBy("conv_id").agg(*[F.sum(x).alias(x) for x in "pgn"], F.count(F.lit(1)).alias("t"))
    return sums.select("conv_id", *[e.alias(k) for k, e in content.conversation_estimate(*[F.col(x) for x in "pgnt"]).items()])


@query(f"SELECT event_id, ts >= date_trunc('day', {NOW_SQL} - INTERVAL 10 DAY + INTERVAL 7 HOUR) - INTERVAL 7 HOUR AS done FROM events")
def done_today(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", content.done_today(F.col("ts").cast("timestamp"), moment(NOW - timedelta(days=10)), "Asia/Ho_Chi_Minh").alias("done"))


# Request records: ids that repeat, times as text, seconds and milliseconds, tokens at the top and within.
_SECOND = {"spark": "unix_seconds(CAST(ts AS TIMESTAMP))", "sql": "CAST(floor(epoch(ts)) AS BIGINT)"}
_DAY = {"spark": "date_format(CAST(ts AS TIMESTAMP), 'yyyy-MM-dd')", "sql": "strftime(ts, '%Y-%m-%d')"}


def _record(d: str) -> str:
    return f"""'{{"id":"r' || (event_id % 5000) || '","model":"m' || (user_id % 7) || '",' || CASE event_id % 3 WHEN 0 THEN '"timestamp":"' || {_DAY[d]} || 'T05:06:07Z"' WHEN 1 THEN '"ts":' || {_SECOND[d]} ELSE '"created_at":' || {_SECOND[d]} || '000' END
|| CASE user_id % 3 WHEN 0 THEN ',"promptTokens":' || (user_id * 2) || ',"completionTokens":3' WHEN 1 THEN ',"tokens":{{"prompt_tokens":' || user_id || ',"completion_tokens":4,"cached_tokens":5}}' ELSE ',"prompt_tokens":0' END || CASE WHEN event_id % 11 = 0 THEN ',"cost":2.5' ELSE '' END || '}}'"""


_RECORDS = """x AS (SELECT event_id, 'r' || (event_id % 5000) AS id, 'm' || (user_id % 7) AS model, CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts) + INTERVAL '5 hours 6 minutes 7 seconds' ELSE date_trunc('second', ts) END AS ts,
CAST(CASE user_id % 3 WHEN 0 THEN user_id * 2 WHEN 1 THEN user_id ELSE 0 END AS BIGINT) AS input_tokens, CAST(CASE user_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 0 END AS BIGINT) AS output_tokens, CAST(CASE user_id % 3 WHEN 1 THEN 5 ELSE 0 END AS BIGINT) AS cached,
CASE WHEN event_id % 11 = 0 THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS cost FROM events)"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.lit("9router").alias("agent"), F.lit("/log").alias("path"), F.col("event_id").alias("line_no"), F.expr(_record("spark")).alias("value"))


_FIRST = "row_number() OVER (PARTITION BY id ORDER BY event_id) AS k"


@query(f"WITH {_RECORDS} SELECT id, {AT_SQL}, model, input_tokens, output_tokens, cost FROM (SELECT *, {_FIRST} FROM x WHERE input_tokens + output_tokens > 0) q WHERE k = 1")
def proxy_claims(spark, sf_dir):
    return logs.proxy_rows(_lines(spark, sf_dir)).select("id", at(), "model", "input_tokens", "output_tokens", "cost")


@query(f"""WITH {_RECORDS}, y AS (SELECT * FROM (SELECT *, {_FIRST} FROM x WHERE input_tokens + output_tokens + cached > 0 OR cost > 0) WHERE k = 1) SELECT 'hotlive:9router:' || id AS id, model, {AT_SQL}, input_tokens + output_tokens + cached AS total_tokens, nullif(cost, 0) AS estimated_cost
FROM y WHERE ts >= {NOW_SQL} - INTERVAL 3 DAY AND ts <= {NOW_SQL} + INTERVAL 5 SECOND""")  # fmt: skip
def hot_rows(spark, sf_dir):
    return logs.live_hot_rows(_lines(spark, sf_dir), NOW, 3 * 24 * 60).select("id", "model", at(), "total_tokens", "estimated_cost")


_LOGS = {
    "start_time": "ts",
    "model": "CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'm' || (user_id % 7) END",
    "provider": "CASE WHEN user_id % 3 > 0 THEN 'p' || (user_id % 3) END",
    "prompt_tokens": "CASE WHEN event_id % 6 > 0 THEN user_id END",
    "completion_tokens": "event_id % 6",
    "spend": "CASE WHEN event_id % 4 = 0 THEN 0.25 ELSE 0.0 END",
    "metadata": "CASE event_id % 4 WHEN 0 THEN '{\"usage_object\":{\"prompt_tokens_details\":{\"cached_tokens\":' || user_id || '}}}' WHEN 1 THEN '{\"usage\":{\"prompt_tokens_details\":{\"cached_tokens\":\"8\"}}}' WHEN 2 THEN 'x' END",
}
_SPEND = """WITH x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, coalesce(CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'm' || (user_id % 7) END, 'mixed') AS model, CASE WHEN user_id % 3 > 0 THEN 'p' || (user_id % 3) ELSE '' END AS provider, CASE WHEN event_id % 6 > 0 THEN user_id ELSE 0 END AS p, event_id % 6 AS c,
CASE WHEN event_id % 4 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS s, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN 8 ELSE 0 END AS r FROM events)
SELECT {keys}, count(*) AS requests, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, sum(s) AS spend, CAST(sum(r) AS BIGINT) AS cached_tokens FROM x WHERE p + c > 0 OR s > 0 GROUP BY {keys}"""


def _spend(spark, sf_dir, *keys):
    rows = table(spark, sf_dir, "events").select(*[F.expr(e).alias(c) for c, e in _LOGS.items()])
    return logs.spend(rows.withColumn("spend", F.col("spend").cast("double")), *keys)


@query(_SPEND.format(keys="day"))
def spend_by_day(spark, sf_dir):
    return _spend(spark, sf_dir)


@query(_SPEND.format(keys="day, model, provider"))
def spend_by_model(spark, sf_dir):
    return _spend(spark, sf_dir, "model", "provider")


# Threads: a summary of each user; purchases are the details that some of them have.
@query("""SELECT user_id AS thread, CAST(0 AS BIGINT) AS event_id, CAST(sum(length(props)) AS BIGINT) AS tokens FROM events GROUP BY user_id HAVING NOT bool_or(event_type = 'purchase' AND value > 100)
UNION ALL SELECT user_id, event_id, length(props) FROM events WHERE event_type = 'purchase' AND value > 100""")  # fmt: skip
def thread_replacement(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), "event_id", F.length("props").cast("long").alias("tokens"), "event_type", "value")
    summaries = e.groupBy("thread").agg(F.lit(0).cast("long").alias("event_id"), F.sum("tokens").alias("tokens"))
    return logs.replace_summaries(summaries, e.filter("event_type = 'purchase' and value > 100").select("thread", "event_id", "tokens"), ["thread"])


@query("""WITH s AS (SELECT 's' || user_id AS session_id, max(ts) AS at, '/w' || (user_id % 9) AS cwd FROM events WHERE user_id % 5 > 0 GROUP BY user_id)
SELECT event_id, strftime(s.at, '%Y-%m-%d %H:%M:%S.%f') AS ts, s.cwd AS workspace FROM events e LEFT JOIN s ON s.session_id = 's' || e.user_id""")  # fmt: skip
def session_attributes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "session_id": F.expr("'s' || user_id")})
    sessions = e.filter("user_id % 5 > 0").select("session_id", F.col("ts").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"), F.expr("'/w' || (user_id % 9)").alias("cwd"))
    return logs.with_sessions(e.select("event_id", "session_id"), sessions).select("event_id", at(), "workspace")


@query(f"WITH {RAW} SELECT id, agent FROM raw_e WHERE agent NOT IN ('grok', 'cursor')")
def enabled_agents(spark, sf_dir):
    return logs.enabled(raw_usage(spark, sf_dir), {"grok": False, "cursor": False, "9router": True}).select("id", "agent")


_BLOB = "CASE event_id % 5 WHEN 0 THEN 'use claude-opus' || (user_id % 3) || ' now' WHEN 1 THEN 'gemini-3.6-flash-high' WHEN 2 THEN 'gpt-' || (event_id % 40) || ' and kimi-k' || (event_id % 7) ELSE 'none' END"


@query("""WITH n AS (SELECT user_id, unnest(CASE event_id % 5 WHEN 0 THEN ['claude-opus' || (user_id % 3)] WHEN 1 THEN ['gemini-3.6-flash-high'] WHEN 2 THEN ['gpt-' || (event_id % 40), 'kimi-k' || (event_id % 7)] ELSE [] END) AS model FROM events),
r AS (SELECT user_id, model, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN contains(model, 'flash-high') THEN 100 WHEN starts_with(model, 'claude-') THEN 55 ELSE 50 END DESC, length(model) DESC, model) AS k FROM n) SELECT user_id, model FROM r WHERE k = 1""")  # fmt: skip
def conversation_models(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.expr(_BLOB).alias("blob"))
    return logs.conversation_models(e, "user_id", "blob")


_KEY = "{{\"key\":\"' || key || '\",\"total_tokens\":' || total_tokens || ',\"event_count\":' || event_count || '}}"
_STARTS = " UNION ALL ".join(f"SELECT '{p}' AS period, {s} AS since" for p, s in {"today": NOW_SQL, "24h": f"{NOW_SQL} - INTERVAL 24 HOUR", "7d": f"{NOW_SQL} - INTERVAL 7 DAY", "30d": f"{NOW_SQL} - INTERVAL 30 DAY", "all": "TIMESTAMP '0001-01-01'"}.items())


@query(f"""WITH {E_SQL}, p AS ({_STARTS}), a AS (SELECT period, agent AS key, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum({REQ}) AS BIGINT) AS event_count FROM e JOIN p ON ts >= since GROUP BY 1, 2)
SELECT period, '[' || string_agg('{_KEY.format()}', ',' ORDER BY key) || ']' AS by_agent FROM a GROUP BY period""")  # fmt: skip
def export_period_stats(spark, sf_dir):
    stats = reports.period_stats(usage(spark, sf_dir), R.rates(spark), NOW)
    return reports.period_documents(stats, ["key", "total_tokens", "event_count"]).select("period", "by_agent").filter("by_agent <> '[]'")
