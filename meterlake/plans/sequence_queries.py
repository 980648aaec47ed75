"""Operators over ordered records: conversations, sessions and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as S
from .adapter import E_SQL, RAW, raw_usage, table, usage
from .queries import query


@query(
    """WITH c AS (SELECT *, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, length(coalesce(text, '')) AS n FROM conversations)
SELECT conv_id, turn, CAST(ceil(b / 4.0) AS BIGINT) AS input_tokens, CAST(ceil(n / 4.0) AS BIGINT) AS output_tokens FROM c WHERE role = 'assistant'"""
)
def context_token_estimate(spark, sf_dir):
    return S.context_estimate(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS model FROM events")
def carry_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("model", F.when(F.col("event_type") == "view", F.col("props")))
    return S.carry_forward(e, ["user_id"], "event_id", ["model"]).select("event_id", "user_id", "model")


@query(
    """WITH a AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS turn, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS done FROM events),
b AS (SELECT *, sum(done) OVER (PARTITION BY user_id, turn ORDER BY event_id) - done AS before FROM a WHERE turn > 0)
SELECT user_id, CAST(turn AS BIGINT) AS turn, CAST(sum(length(props)) AS BIGINT) AS chars, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS end_ts FROM b WHERE before = 0 GROUP BY user_id, turn HAVING max(done) = 1"""
)
def turn_segments(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = S.turn_segments(e, ["user_id"], "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase", {"chars": F.length("props")})
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("user_id", "turn", "chars", stamp("start_ts"), stamp("end_ts"))


@query(f"WITH {RAW}, c AS (SELECT *, sum(input_tokens) OVER (PARTITION BY agent, model ORDER BY seq) * CASE WHEN seq % 97 = 0 THEN 0 ELSE 1 END AS total FROM raw_e) SELECT id, CAST(greatest(0, total - coalesce(lag(total) OVER (PARTITION BY agent, model ORDER BY seq), 0)) AS BIGINT) AS total FROM c")
def cumulative_delta(spark, sf_dir):
    rows = raw_usage(spark, sf_dir)
    total = F.sum("input_tokens").over(S.running_window(["agent", "model"], "seq")) * F.when(F.col("seq") % 97 == 0, 0).otherwise(1)
    return S.cumulative_delta(rows.withColumn("total", total), ["agent", "model"], "seq", ["total"]).select("id", "total")


_COUNTERS = f"""{RAW}, r AS MATERIALIZED (SELECT seq, source_path, input_tokens AS i, output_tokens AS o, cache_read_tokens AS c, cache_write_tokens AS w, CASE WHEN seq % 5 = 0 THEN 'token_count' ELSE 'message' END AS kind, row_number() OVER (PARTITION BY source_path ORDER BY seq) AS k FROM raw_e),
f AS (SELECT DISTINCT source_path, CAST(0 AS BIGINT) AS k, false AS run, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS o, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS w, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS kind, CAST(0 AS BIGINT) AS di, CAST(0 AS BIGINT) AS d_o, CAST(0 AS BIGINT) AS dc, CAST(0 AS BIGINT) AS dw FROM r
UNION ALL SELECT source_path, k, run, CASE WHEN total THEN ni ELSE i END, CASE WHEN total THEN n_o ELSE o END, CASE WHEN total THEN nc ELSE c END, CASE WHEN total THEN nw ELSE w END, seq, kind, CASE WHEN total THEN greatest(0, ni - i) ELSE ni END, CASE WHEN total THEN greatest(0, n_o - o) ELSE n_o END, CASE WHEN total THEN greatest(0, nc - c) ELSE nc END, CASE WHEN total THEN greatest(0, nw - w) ELSE nw END
FROM (SELECT *, run AND NOT (ni < i AND n_o < o) AS total FROM (SELECT r.source_path, r.k, f.run OR (r.kind = 'token_count' AND greatest(r.i, r.o) > 0) AS run, f.i, f.o, f.c, f.w, r.seq, r.kind, r.i AS ni, r.o AS n_o, r.c AS nc, r.w AS nw FROM f JOIN r ON r.source_path = f.source_path AND r.k = f.k + 1) x) y)"""


@query(f"WITH RECURSIVE {_COUNTERS} SELECT seq, source_path, di AS input_tokens, d_o AS output_tokens, dc AS cache_read_tokens, dw AS cache_write_tokens, kind FROM f WHERE k > 0")
def counter_deltas(spark, sf_dir):
    """Counters of unknown mode: each user's log, in order."""
    rows = raw_usage(spark, sf_dir).select("seq", "source_path", F.col("input_tokens"), "output_tokens", "cache_read_tokens", "cache_write_tokens", F.when(F.col("seq") % 5 == 0, "token_count").otherwise("message").alias("kind"))
    return S.counter_deltas(rows, "source_path", "seq")


_PROMPTS = "SELECT seq, agent, seq // 40 AS prompt, total_tokens, cache_read_tokens, output_tokens, estimated AND seq % 3 = 0 AS done FROM e"


@query(
    f"""WITH {E_SQL}, p AS ({_PROMPTS}), x AS (SELECT *, min(CASE WHEN done THEN seq END) OVER (PARTITION BY agent, prompt) AS upto FROM p)
SELECT agent, prompt, max(total_tokens) AS peak_total, max(cache_read_tokens) AS peak_cached, CAST(sum(output_tokens) AS BIGINT) AS output_chars FROM x WHERE upto IS NULL OR seq <= upto GROUP BY agent, prompt"""
)
def prompt_peaks(spark, sf_dir):
    rows = usage(spark, sf_dir).withColumn("prompt", F.floor(F.col("seq") / 40))
    return S.prompt_peaks(rows, ["agent", "prompt"], "seq", F.col("estimated") & (F.col("seq") % 3 == 0), "total_tokens", "cache_read_tokens", "output_tokens")


# Windows: the rows of one agent; calls: those of routers.
_CLAIMS = r"""calls AS (SELECT id AS call_id, ts, model FROM raw_e WHERE agent IN ('9router', 'routerlab')), windows AS (SELECT seq, ts AS start_ts, ts + INTERVAL 4 MINUTE AS end_ts, model FROM raw_e WHERE agent = 'grok'),
met AS (SELECT c.call_id, w.seq, regexp_replace(string_split(lower(trim(c.model)), '/')[-1], '[_\s]+', '-', 'g') AS a, regexp_replace(string_split(lower(trim(w.model)), '/')[-1], '[_\s]+', '-', 'g') AS b FROM calls c JOIN windows w ON c.ts >= w.start_ts AND c.ts <= w.end_ts + INTERVAL 2 SECOND),
claims AS (SELECT call_id, min(seq) AS window_seq FROM met WHERE coalesce(a, '') = '' OR coalesce(b, '') = '' OR a = b OR contains(a, b) OR contains(b, a) OR regexp_replace(regexp_replace(a, '-\(x?high\)$', ''), '-x?high$', '') = regexp_replace(regexp_replace(b, '-\(x?high\)$', ''), '-x?high$', '') GROUP BY 1)"""


def _claims(spark, sf_dir):
    rows = raw_usage(spark, sf_dir)
    calls = rows.filter(F.col("agent").isin("9router", "routerlab")).select(F.col("id").alias("call_id"), "ts", "model")
    windows = rows.filter("agent = 'grok'").select("seq", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 4 MINUTES")).alias("end_ts"), "model")
    return windows, S.interval_claims(calls, windows)


@query(f"WITH {RAW}, {_CLAIMS} SELECT call_id, window_seq FROM claims")
def interval_claim_join(spark, sf_dir):
    return _claims(spark, sf_dir)[1].select("call_id", "window_seq")


@query(f"WITH {RAW}, {_CLAIMS} SELECT seq, model FROM windows WHERE seq NOT IN (SELECT window_seq FROM claims)")
def anti_join_unclaimed(spark, sf_dir):
    windows, claims = _claims(spark, sf_dir)
    return S.unclaimed(windows, claims).select("seq", "model")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)")
def anti_join_covered(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return S.uncovered(e.select("user_id").distinct(), e.filter("event_type = 'purchase' and value > 150"), "user_id")


@query(
    f"""WITH {RAW}, parts AS (SELECT source_path AS session_id, sum(input_tokens) AS i, sum(output_tokens + cache_write_tokens) AS o, sum(cache_read_tokens) AS c, count(*) AS n FROM raw_e WHERE agent IN ('grok', 'windsurf') AND seq % 4 = 0 GROUP BY 1),
s AS (SELECT source_path AS session_id, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_write_tokens) AS w, sum(cache_read_tokens) AS c, count(*) AS n FROM raw_e WHERE agent IN ('grok', 'windsurf') GROUP BY 1),
g AS (SELECT s.session_id, greatest(0, s.i - coalesce(p.i, 0)) AS i, greatest(0, s.o + s.w - coalesce(p.o, 0)) AS o, greatest(0, s.c - coalesce(p.c, 0)) AS c, greatest(0, s.n - coalesce(p.n, 0)) AS n FROM s LEFT JOIN parts p USING (session_id))
SELECT session_id, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(c AS BIGINT) AS cache_read_tokens, CAST(n AS BIGINT) AS api_calls FROM g WHERE i + o + c > 0"""
)
def gap_fill_sessions(spark, sf_dir):
    rows = raw_usage(spark, sf_dir).filter("agent in ('grok', 'windsurf')").withColumn("session_id", F.col("source_path"))
    sums = [F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cache_read_tokens").alias("cache_read_tokens"), F.sum("cache_write_tokens").alias("reasoning_tokens"), F.count(F.lit(1)).alias("api_calls"), F.max("ts").alias("ts"), F.max("model").alias("model"), F.max("workspace").alias("workspace"), F.lit(0).alias("cache_write_tokens"), F.lit(None).cast("double").alias("cost")]
    sessions, parts = (r.groupBy("session_id").agg(*sums) for r in (rows, rows.filter("seq % 4 = 0")))
    return S.session_gaps(sessions, parts).select("session_id", "input_tokens", "output_tokens", "cache_read_tokens", "api_calls")


@query(
    f"""WITH {RAW}, s AS (SELECT workspace, model, sum(output_tokens) AS t, min(seq) AS o FROM raw_e WHERE model IS NOT NULL AND workspace IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY t DESC, o) AS k FROM s)
SELECT workspace, model, CAST(t AS BIGINT) AS tokens FROM n WHERE k = 1"""
)
def argmax_model(spark, sf_dir):
    rows = raw_usage(spark, sf_dir).filter("model is not null and workspace is not null").withColumn("tokens", F.col("output_tokens"))
    return S.argmax_model(rows, ["workspace"])


@query(
    r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{4,}')) AS token, generate_subscripts(regexp_extract_all(text, '[a-z]{4,}'), 1) AS pos FROM documents),
c AS (SELECT doc_id, token, count(*) AS n, min(pos) AS pos FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS k FROM c) SELECT doc_id, token, n FROM r WHERE k = 1"""
)
def dominant_token(spark, sf_dir):
    return S.dominant_token(table(spark, sf_dir, "documents"), "doc_id", "text", "[a-z]{4,}")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5")
def newest_per_source(spark, sf_dir):
    return S.newest(table(spark, sf_dir, "events"), ["user_id"], "event_id", 5).select("user_id", "event_id")
