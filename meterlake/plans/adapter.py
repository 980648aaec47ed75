"""Usage rows from the ``events`` table, which holds no token logs: a fixed projection, in both dialects."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rates as R
from ..operators.pricing import RATES as RATE_COLUMNS
from ..operators.pricing import price_events
from ..schema import USAGE, conform

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
AGENTS = ["claude-code", "cursor", "grok", "9router", "routerlab", "windsurf"]
MODELS = ["claude-sonnet-4 (prov-a)", "openai/gpt-4.1", "grok-4.5", "GLM-5.1|prov-b", "deep-seek-v4-flash", "kimi-k3", "totally-unknown"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(c, values):
    out = F.when(c == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(c == i, v)
    return out


def raw_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without prices, with ``router_cost``."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    text = lambda c: c.cast("string")
    user, kind, none = F.col("user_id"), F.col("event_type"), F.lit(0).cast("long")
    agent = _case(user % 6, AGENTS)
    out = e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("ev"), text(F.col("event_id"))).alias("id"),
        agent.alias("agent"),
        _case(F.col("k") % 8, MODELS).alias("model"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"),
        (F.col("k") * 10).cast("long").alias("output_tokens"),
        F.when(kind == "view", F.floor(F.col("value") * 400).cast("long")).otherwise(none).alias("cache_read_tokens"),
        F.when(kind == "signup", F.col("k").cast("long")).otherwise(none).alias("cache_write_tokens"),
        F.when(kind == "purchase", F.col("value") / 1000).alias("router_cost"),
        (kind == "error").alias("estimated"),
        F.when(kind == "error", 1 + F.col("k") % 20).cast("long").alias("request_count"),
        F.when(user % 4 != 0, F.concat(F.lit("provider:p"), text(user % 3))).alias("workspace"),
        F.when(user % 6 == 2, F.concat(F.lit("/s"), text(user % 50), F.lit("/updates.jsonl"))).when(user % 6 == 5, F.concat(F.lit("\\C\\w"), text(user % 40), F.lit(".pb"))).otherwise(F.concat(F.lit("/"), agent)).alias("source_path"),
    )
    return out


def priced(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return conform(price_events(rows, R.rates(spark)))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced rows."""
    return priced(spark, raw_usage(spark, sf_dir))


def rated_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced rows with the rates they were priced with."""
    rows = price_events(raw_usage(spark, sf_dir), R.rates(spark), keep_rates=True)
    return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in USAGE], *RATE_COLUMNS)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _sql_case(expression: str, values: list[str]) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def norm_sql(x: str) -> str:
    """``normalize_model`` in SQL."""
    strip = lambda e: rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"
    m = strip(x)
    for _ in range(3):
        m = strip(rf"regexp_replace({m}, '\s*\([^)]*\)\s*$', '')")
    m = strip(rf"regexp_replace({m}, '\s*\[[^\]]*\]\s*$', '')")
    m = strip(f"split_part({m}, '|', 1)")
    last = strip(rf"regexp_extract({m}, '([^/]*[^/\s][^/]*)(?:/\s*)*$', 1)")
    m = rf"CASE WHEN contains({m}, '/') AND NOT starts_with({m}, 'http') AND length({last}) >= 2 AND NOT regexp_matches(lower({last}), '^(models?|v\d+)$') THEN {last} ELSE {m} END"
    m = strip(rf"regexp_replace({strip(rf"regexp_replace({m}, '\s+', ' ', 'g')")}, '[-_:|]+$', '')")
    m = f"regexp_replace({m}, '^deep[-_]seek', 'deepseek', 'i')"
    return f"nullif(regexp_replace({m}, '^digigo$', 'Digigo', 'i'), '')"


def family_sql(raw: str) -> str:
    return "CASE " + " ".join("WHEN " + " AND ".join(f"contains({raw}, '{p}')" for p in parts) + f" THEN '{key}'" for parts, key in R.FAMILIES) + " END"


#: CTEs: raw_e (without prices), rates, mods (models with their rates), e (priced rows).
RAW = f"""raw_e AS (SELECT event_id AS seq, 'ev' || event_id AS id, {_sql_case("user_id % 6", AGENTS)} AS agent, {_sql_case("k % 8", MODELS)} AS model, ts,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(k * 10 AS BIGINT) AS output_tokens,
  CASE WHEN event_type = 'view' THEN CAST(floor(value * 400) AS BIGINT) ELSE 0 END AS cache_read_tokens, CASE WHEN event_type = 'signup' THEN CAST(k AS BIGINT) ELSE 0 END AS cache_write_tokens,
  CASE WHEN event_type = 'purchase' THEN value / 1000 END AS router_cost, event_type = 'error' AS estimated, CASE WHEN event_type = 'error' THEN CAST(1 + k % 20 AS BIGINT) END AS request_count,
  CASE WHEN user_id % 4 <> 0 THEN 'provider:p' || (user_id % 3) END AS workspace,
  CASE user_id % 6 WHEN 2 THEN '/s' || (user_id % 50) || '/updates.jsonl' WHEN 5 THEN '\\C\\w' || (user_id % 40) || '.pb' ELSE '/' || {_sql_case("user_id % 6", AGENTS)} END AS source_path
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) x)"""
RATES = f"""rates AS (SELECT ord, key, CAST(i AS DOUBLE) AS i, CAST(o AS DOUBLE) AS o, CAST(r AS DOUBLE) AS r, CAST(w AS DOUBLE) AS w, CAST(l AS BIGINT) AS l FROM (VALUES {_values(R.parse())}) v(ord, key, i, o, r, w, l)),
aliases AS (SELECT * FROM (VALUES {_values(R.ALIASES.items())}) v(name, key))"""


def mods_sql(source: str) -> str:
    """CTE mods for the distinct models of a query."""
    return f"""mods AS (WITH m AS (SELECT DISTINCT model FROM ({source})), n AS (SELECT model, nullif(lower(coalesce({norm_sql("model")}, model)), '') AS raw FROM m),
  p AS (SELECT n.model, arg_max(t.key, length(t.key) * 1000 - t.ord) AS key FROM n JOIN rates t ON length(t.key) >= 5 AND t.key <> 'default' AND (contains(n.raw, t.key) OR contains(replace(n.raw, '_', '-'), t.key)) GROUP BY n.model),
  k AS (SELECT n.model, n.raw, coalesce(a.key, x.key, p.key, {family_sql("n.raw")}) AS key FROM n LEFT JOIN aliases a ON a.name = n.raw LEFT JOIN rates x ON x.key = n.raw LEFT JOIN p ON p.model = n.model)
  SELECT k.model, coalesce(k.key, 'default') AS rate_key, CASE WHEN t.key IS NULL THEN 'default' ELSE 'bundled' END AS rate_source, coalesce(t.i, d.i) AS i, coalesce(t.o, d.o) AS o,
    CASE WHEN t.key IS NULL THEN d.r ELSE t.r END AS r, CASE WHEN t.key IS NULL THEN d.w ELSE t.w END AS w, t.l FROM k LEFT JOIN rates t ON t.key = k.key, rates d WHERE d.key = 'default')"""


def parts_sql(actual: str | None) -> str:
    """Columns into, outof, cache and table_cost of rows with rates, in a subquery c."""
    mult = "CASE WHEN l > 0 AND input_tokens + cache_read_tokens >= l THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
    inner = f"*, input_tokens * (i * {mult}) / 1e6 AS t_in, output_tokens * (o * {mult}) / 1e6 AS t_out, (cache_read_tokens * (coalesce(r, i * 0.1::DOUBLE) * {mult}) + cache_write_tokens * (coalesce(w, i * 1.25::DOUBLE) * {mult})) / 1e6 AS t_cache"
    scale = f"CASE WHEN {actual} IS NOT NULL AND t_in + t_out + t_cache > 1e-15 AND abs({actual} - (t_in + t_out + t_cache)) > 1e-12 THEN {actual} / (t_in + t_out + t_cache) ELSE 1.0::DOUBLE END" if actual else "1.0::DOUBLE"
    return f"SELECT *, t_in * s AS input_cost, t_out * s AS output_cost, t_cache * s AS cache_cost, t_in + t_out + t_cache AS table_cost FROM (SELECT *, {scale} AS s FROM (SELECT {inner} FROM {{rows}}))"


TOKENS_SQL = "input_tokens + output_tokens + cache_read_tokens + cache_write_tokens"
PRICED = f"""priced AS ({parts_sql(None).format(rows="(SELECT raw_e.*, rate_key, rate_source, i, o, r, w, l FROM raw_e JOIN mods ON raw_e.model IS NOT DISTINCT FROM mods.model)")}),
e AS (SELECT seq, id, agent, model, ts, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, {TOKENS_SQL} AS total_tokens,
  CASE WHEN router_cost > 0 THEN router_cost WHEN {TOKENS_SQL} = 0 OR (i = 0 AND o = 0) THEN 0.0::DOUBLE ELSE table_cost END AS estimated_cost,
  CASE WHEN estimated THEN 'estimated' WHEN router_cost > 0 THEN 'priced' WHEN {TOKENS_SQL} = 0 OR (i = 0 AND o = 0) THEN 'zero_rate' WHEN rate_source = 'default' THEN 'unknown_model' ELSE 'priced' END AS pricing_status,
  workspace, source_path, estimated, request_count FROM priced)"""
#: Parts of priced rows, scaled to their cost.
PARTS = f"""parts AS ({parts_sql("estimated_cost").format(rows="(SELECT e.*, i, o, r, w, l FROM e JOIN mods ON e.model IS NOT DISTINCT FROM mods.model)")})"""
E_SQL = f"{RAW}, {RATES}, {mods_sql('SELECT model FROM raw_e')}, {PRICED}"
#: Requests that a row stands for.
REQ = "CASE WHEN request_count > 0 THEN request_count ELSE 1 END"
