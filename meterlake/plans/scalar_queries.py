"""Scalar functions over text and numbers drawn from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, time
from ..operators import pricing
from ..operators import sequences as S
from .adapter import E_SQL, NOW, NOW_SQL, norm_sql, table, usage
from .queries import query

# Names as logs have them, spread over the rows of ``part``.
_FORMS = ["p_name", "p_brand || '/' || p_name", "p_name || ' (via ' || p_brand || ')'", "p_name || '|' || p_brand", "'Deep-Seek-v' || p_size || ' [' || p_brand || ']'", "'models/v' || p_size", "' digigo  '", "p_name || '  x (a (b)) (c) :-'"]
_NAME = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END"


@query(f"SELECT p_partkey, {norm_sql('name')} AS model FROM (SELECT p_partkey, {_NAME} AS name FROM part)")
def normalize_model(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_model(F.expr(_NAME)).alias("model"))


_NUMBERS = "CASE event_id % 8 WHEN 0 THEN CAST(user_id AS {T}) WHEN 1 THEN ' ' || user_id || '.5 ' WHEN 2 THEN user_id || 'e3' WHEN 3 THEN 'n' || user_id WHEN 4 THEN '' WHEN 5 THEN '-.' || user_id WHEN 6 THEN 'Infinity' END"


@query(r"""SELECT event_id, CASE WHEN regexp_matches(t, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN coalesce(TRY_CAST(t AS DOUBLE), 0) ELSE 0.0 END AS n FROM (SELECT event_id, trim(""" + _NUMBERS.format(T="VARCHAR") + ") AS t FROM events)")
def num_coerce(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.num(F.expr(_NUMBERS.format(T="STRING"))).alias("n"))


@query("SELECT event_id, substr(sha256(event_type || '|' || user_id || '|' || CASE WHEN event_id % 3 = 0 THEN '' ELSE props END), 1, 24) AS id FROM events")
def stable_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.stable_id(F.col("event_type"), F.col("user_id"), F.when(F.col("event_id") % 3 != 0, F.col("props"))).alias("id"))


_AGENT = "CASE user_id % 6 WHEN 0 THEN ' XLabRouter' WHEN 1 THEN 'xlab_router ' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'Codex' ELSE 'none-' || user_id END"


@query(f"""WITH a AS (SELECT user_id, lower(trim({_AGENT})) AS a, {_AGENT} AS given FROM (SELECT DISTINCT user_id FROM events)), n AS (SELECT user_id, given, CASE WHEN coalesce(a, '') = '' THEN 'custom' WHEN a IN ('xlabrouter', 'xlrouter', 'xlab-router', 'xlab_router') THEN 'routerlab' ELSE a END AS agent FROM a)
SELECT user_id, agent, CASE agent WHEN 'routerlab' THEN 'RouterLab' WHEN 'codex' THEN 'OpenAI Codex (App)' ELSE coalesce(nullif(given, ''), 'unknown') END AS label FROM n""")  # fmt: skip
def normalize_agent(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("given", F.expr(_AGENT))
    return users.select("user_id", text.normalize_agent(F.col("given")).alias("agent"), text.agent_label(F.col("given")).alias("label"))


_PROVIDERS = ["'claude-x'", "'GPT-5'", "'o3-mini'", "'acme/' || p_brand", "'/lone'", "'Qwen' || p_size", "'stepfun-1'", "'meta-' || p_size", "'the-nemotron'", "'swe-1'", "'my-cursor'", "p_name"]
_PROVIDER = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_PROVIDERS)) + " END"
_PREFIXES = " ".join(f"WHEN starts_with(m, '{a}') THEN '{b}'" for a, b in text.PROVIDER_PREFIXES)


@query(f"""SELECT p_partkey, CASE WHEN m = '' THEN 'other' WHEN contains(m, '/') THEN CASE WHEN split_part(m, '/', 1) = '' THEN 'other' ELSE split_part(m, '/', 1) END {_PREFIXES} WHEN contains(m, 'nemotron') THEN 'nvidia' WHEN starts_with(m, 'mimo') THEN 'xiaomi'
WHEN contains(m, 'windsurf') OR starts_with(m, 'swe-') OR m = 'cascade' THEN 'windsurf' WHEN contains(m, 'cursor') THEN 'cursor' ELSE 'other' END AS provider FROM (SELECT p_partkey, lower(trim({_PROVIDER})) AS m FROM part)""")  # fmt: skip
def guess_provider(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.guess_provider(F.expr(_PROVIDER)).alias("provider"))


@query("""SELECT o_orderkey, CASE WHEN v < 0 THEN '-$' ELSE '$' END || translate(format('{:,.4f}', abs(v)), ',.', '.,') AS usd FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END AS v FROM orders)""")
def format_usd(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.format_usd(F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))).alias("usd"))


@query("""SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN format('{:.2f}B', n / 1e9) WHEN n >= 1000000 THEN format('{:.2f}M', n / 1e6) WHEN n >= 1000 THEN format('{:.1f}K', n / 1e3) ELSE CAST(n AS VARCHAR) END AS shown
FROM (SELECT o_orderkey, CAST(power(7, o_orderkey % 12) AS BIGINT) * 3 AS n FROM orders)""")  # fmt: skip
def format_tokens(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.format_tokens(F.pow(F.lit(7), F.col("o_orderkey") % 12).cast("long") * 3).alias("shown"))


@query("SELECT doc_id, CASE WHEN coalesce(n_chars, 0) <= 0 THEN 0 ELSE CAST(ceil(n_chars / 4.0) AS BIGINT) END AS n_tokens FROM documents")
def text_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tokens_of_chars(F.col("n_chars")).alias("n_tokens"))


_SIZE = "greatest(1, CAST(floor(n / CASE WHEN n < 50000 THEN 8.0::DOUBLE ELSE 12.0::DOUBLE END + 0.5) AS BIGINT))"


@query(f"WITH s AS (SELECT doc_id, {_SIZE} AS t FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)), i AS (SELECT *, CAST(floor(t * 0.65::DOUBLE + 0.5) AS BIGINT) AS i FROM s) SELECT doc_id, i AS input_tokens, greatest(1, t - i) AS output_tokens FROM i")
def size_token_estimate(spark, sf_dir):
    parts = S.size_estimate(F.octet_length(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in parts.items()])


@query("SELECT doc_id, CASE WHEN v IS NULL OR v <= 0 THEN 0.0::DOUBLE ELSE floor(v * 1e6 * 1e6 + 0.5) / 1e6 END AS rate FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars / 1e9 WHEN 1 THEN -1.0 WHEN 2 THEN NULL ELSE n_chars / 1e13 END AS v FROM documents)")
def per_token_to_1m(spark, sf_dir):
    v = F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") / F.lit(1e9)).when(F.col("doc_id") % 4 == 1, -1.0).when(F.col("doc_id") % 4 == 3, F.col("n_chars") / F.lit(1e13))
    return table(spark, sf_dir, "documents").select("doc_id", pricing.per_million(v).alias("rate"))


@query("SELECT event_id, strftime(date_trunc('day', ts + INTERVAL 7 HOUR) - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS day_start FROM events")
def start_of_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.date_format(time.start_of_day(F.col("ts").cast("timestamp"), "Asia/Ho_Chi_Minh"), "yyyy-MM-dd HH:mm:ss").alias("day_start"))


@query(f"""WITH {E_SQL} SELECT id, CAST(greatest(0, total_tokens - cache_read_tokens) AS BIGINT) AS uncached, CASE agent WHEN 'grok' THEN greatest(output_tokens, cache_write_tokens) WHEN 'cursor' THEN output_tokens ELSE output_tokens END AS output_tokens, seq / 1e10 AS usd FROM e""")
def uncached_split(spark, sf_dir):
    return usage(spark, sf_dir).select("id", S.uncached(F.col("total_tokens"), F.col("cache_read_tokens")).cast("long").alias("uncached"), S.output_with_reasoning(F.col("output_tokens"), F.col("cache_write_tokens"), F.col("agent")).alias("output_tokens"), S.of_ticks(F.col("seq")).alias("usd"))


@query(f"""SELECT user_id, day, strftime(CASE WHEN h <= 12 THEN day::TIMESTAMP + to_hours(h) WHEN day::TIMESTAMP + INTERVAL 12 HOUR <= {NOW_SQL} - INTERVAL 7 DAY THEN day::TIMESTAMP + INTERVAL 12 HOUR ELSE day::TIMESTAMP END, '%Y-%m-%d %H:%M:%S') AS stamp
FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(CAST(date_part('hour', ts) AS INT)) AS h FROM events GROUP BY ALL)""")  # fmt: skip
def synthetic_ts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max(F.hour("ts")).alias("h"))
    at = F.to_timestamp("day", "yyyy-MM-dd") + F.make_dt_interval(hours=F.col("h"))
    from datetime import timedelta

    return days.select("user_id", "day", F.date_format(time.rollup_moment(F.col("day"), at, time.moment(NOW - timedelta(days=7))), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("SELECT event_id, event_id * 12345.0::DOUBLE / 1e10::DOUBLE AS usd FROM events")
def cost_ticks(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.of_ticks(F.col("event_id") * F.lit(12345.0)).alias("usd"))


_POLICY = "CASE user_id % 3 WHEN 0 THEN 'grok' WHEN 1 THEN 'hermes' ELSE 'cursor' END"


@query(f"""WITH p AS (SELECT event_id, {_POLICY} AS agent, CAST(floor(value) AS BIGINT) AS o, CASE WHEN event_id % 4 > 0 THEN event_id % 90 END AS r FROM events)
SELECT event_id, agent, CASE agent WHEN 'grok' THEN greatest(o, coalesce(r, 0)) WHEN 'hermes' THEN o + coalesce(r, 0) ELSE o END AS output_tokens FROM p""")
def reasoning_policy(spark, sf_dir):
    reasoning = F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 90)
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_POLICY).alias("agent"), F.floor("value").cast("long").alias("o"), reasoning.alias("r"))
    return rows.select("event_id", "agent", S.output_with_reasoning(F.col("o"), F.col("r"), F.col("agent")).alias("output_tokens"))


_SPOKEN = "CASE user_id % 6 WHEN 0 THEN ' Grok ' WHEN 1 THEN 'hermes' WHEN 2 THEN 'DEVIN' WHEN 3 THEN '' WHEN 4 THEN 'unheard-of' END"


@query(f"""SELECT event_id, CASE lower(trim(a)) WHEN 'grok' THEN 'Grok (xAI)' WHEN 'hermes' THEN 'Hermes Agent' WHEN 'devin' THEN 'Devin' ELSE coalesce(nullif(a, ''), 'unknown') END AS label FROM (SELECT event_id, {_SPOKEN} AS a FROM events)""")
def agent_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.agent_label(F.expr(_SPOKEN)).alias("label"))


@query()
def model_from_text(spark, sf_dir):
    """Texts that name models among other words."""
    forms = ["'use ' || p_name || ' gemini-2.5-pro or gemini-3.6-flash-high now'", "'MODEL_PLACEHOLDER_M71 and claude-opus'", "'Model Selection from a to Gemini 3.6 Flash (Tiered)'", "'nothing'", "'kimi-k' || p_size || ' gpt-' || p_size"]
    form = "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"
    return table(spark, sf_dir, "part").select("p_partkey", text.model_from_text(F.expr(form)).alias("model"))
