"""Pricing of usage rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rates as R
from ..operators import catalog as C
from ..operators import pricing as P
from .adapter import E_SQL, PARTS, RATES, RAW, TOKENS_SQL, mods_sql, norm_sql, raw_usage, table, usage
from .queries import query


@query(f"WITH {E_SQL} SELECT id, total_tokens, round(estimated_cost, 9) AS estimated_cost, pricing_status FROM e")
def price_events(spark, sf_dir):
    return usage(spark, sf_dir).select("id", "total_tokens", F.round("estimated_cost", 9).alias("estimated_cost"), "pricing_status")


@query(f"WITH {E_SQL}, {PARTS} SELECT id, round(input_cost, 9) AS input_cost, round(cache_cost, 9) AS cache_cost, round(output_cost, 9) AS output_cost, round(table_cost, 9) AS table_cost FROM parts")
def cost_parts(spark, sf_dir):
    rated = P.with_rates(usage(spark, sf_dir), R.rates(spark))
    return rated.select("id", *[F.round(c, 9).alias(n) for n, c in P.cost_parts(F.col("estimated_cost")).items()])


# Names that take every tier of the resolution.
_TIERS = ["p_name", "'acme/Claude-Opus-4.7-thinking (x)'", "'my_gpt-5.5_high_' || p_size", "'claude-new-sonnet-lite'", "'deep_seek-' || p_size || '-pro'", "'grok-9-fast'", "'composer'", "'O3'", "'gemini-9'", "'kimi_k3_turbo'", "'gpt-4o-mini-' || p_size"]
_TIER = "CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_TIERS)) + " END"


@query(f"WITH names AS (SELECT DISTINCT {_TIER} AS model FROM part), {RATES}, {mods_sql('SELECT model FROM names')} SELECT model, rate_key, rate_source, i AS input_rate, o AS output_rate, r AS cache_read_rate FROM mods")
def resolve_model_key(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.expr(_TIER).alias("model"))
    return P.model_rates(names, R.rates(spark)).select("model", F.col("key").alias("rate_key"), F.col("source").alias("rate_source"), "input_rate", "output_rate", "cache_read_rate")


_CUSTOM = {"kimi-k3": (9, 99), "totally-unknown": (1, 1, 0.5)}
_TABLE = "CASE WHEN {t} = 0 OR (i = 0 AND o = 0) THEN 0.0::DOUBLE ELSE table_cost END"


@query(
    f"""WITH {E_SQL}, rows AS (SELECT e.*, CASE m.model WHEN 'kimi-k3' THEN 9.0::DOUBLE WHEN 'totally-unknown' THEN 1.0::DOUBLE ELSE i END AS i, CASE m.model WHEN 'kimi-k3' THEN 99.0::DOUBLE WHEN 'totally-unknown' THEN 1.0::DOUBLE ELSE o END AS o,
  CASE m.model WHEN 'kimi-k3' THEN NULL WHEN 'totally-unknown' THEN 0.5::DOUBLE ELSE r END AS r, CASE WHEN m.model IN ('kimi-k3', 'totally-unknown') THEN NULL ELSE w END AS w, l, coalesce(m.model IN ('kimi-k3', 'totally-unknown'), false) AS own FROM e JOIN mods m ON e.model IS NOT DISTINCT FROM m.model),
c AS (SELECT *, input_tokens * (i * m) / 1e6 + output_tokens * (o * m) / 1e6 + (cache_read_tokens * (coalesce(r, i * 0.1::DOUBLE) * m) + cache_write_tokens * (coalesce(w, i * 1.25::DOUBLE) * m)) / 1e6 AS table_cost FROM (SELECT *, CASE WHEN l > 0 AND input_tokens + cache_read_tokens >= l THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS m FROM rows))
SELECT id, round(CASE WHEN NOT own AND estimated_cost > 0 THEN estimated_cost ELSE {_TABLE.format(t=TOKENS_SQL)} END, 9) AS estimated_cost FROM c"""
)
def reprice_events(spark, sf_dir):
    out = P.reprice_events(usage(spark, sf_dir), R.rates(spark), R.rates(spark, _CUSTOM))
    return out.select("id", F.round("estimated_cost", 9).alias("estimated_cost"))


@query(f"WITH {RAW}, {RATES}, {mods_sql('SELECT model FROM raw_e')}, c AS (SELECT raw_e.*, m.i, m.o, m.r, m.w, m.l FROM raw_e JOIN mods m ON raw_e.model IS NOT DISTINCT FROM m.model) SELECT agent, round(sum((input_tokens * i + output_tokens * o + cache_read_tokens * coalesce(r, i * 0.1::DOUBLE) + cache_write_tokens * coalesce(w, i * 1.25::DOUBLE)) * CASE WHEN l > 0 AND input_tokens + cache_read_tokens >= l THEN 2 ELSE 1 END / 1e6), 9) AS table_total FROM c GROUP BY agent")
def reprice_totals(spark, sf_dir):
    """Totals by rates alone, as after a change of rates."""
    forced = P.reprice_events(usage(spark, sf_dir), R.rates(spark), force=True)
    return forced.groupBy("agent").agg(F.round(F.sum("estimated_cost"), 9).alias("table_total"))


@query(f"WITH {RAW}, {RATES}, names AS (SELECT key AS model FROM rates WHERE key <> 'default' UNION SELECT coalesce({norm_sql('model')}, model) FROM raw_e WHERE model IS NOT NULL), {mods_sql('SELECT model FROM names')} SELECT model, rate_key AS key, rate_source AS source, i AS input_rate, o AS output_rate, r AS cache_read_rate, w AS cache_write_rate FROM mods")
def pricing_catalog(spark, sf_dir):
    return P.pricing_catalog(raw_usage(spark, sf_dir), R.rates(spark)).drop("long_context")


def _documents(spark):
    """A small catalog document, as the external service gives it."""
    import json

    price = lambda a, b, **k: {"prompt": str(a), "completion": str(b), **k}
    models = [
        {"id": "google/gemini-3.6-flash", "name": "Flash", "pricing": price(3e-7, 2.5e-6, input_cache_read="0.00000003"), "context_length": 1000000, "created": 30},
        {"id": "google/gemini-3.1-pro-preview", "name": "Pro", "pricing": price(1.25e-6, 1e-5), "created": 20},
        {"id": "moonshotai/kimi-k3", "name": "K3", "pricing": price(6e-7, 2.5e-6), "created": 10},
        {"id": "acme/kimi-k3:free", "name": "K3 free", "pricing": price(0, 0), "created": 11},
        {"id": "~acme/alias", "pricing": price(1, 1)},
        {"id": "acme/claude-sonnet-4", "pricing": price(-1, "x")},
    ]
    return spark.createDataFrame([(json.dumps({"data": models}),)], "value string")


# The catalog's rows as they are meant, and names peeled end by end until none fits.
_CATALOG_SQL = """cat AS (SELECT *, string_split(id, '/')[-1] AS slug, string_split(id, '/')[1] AS provider FROM (VALUES ('google/gemini-3.6-flash', 0.3::DOUBLE, 2.5::DOUBLE, 0.03::DOUBLE), ('google/gemini-3.1-pro-preview', 1.25, 10, NULL), ('moonshotai/kimi-k3', 0.6, 2.5, NULL), ('acme/kimi-k3:free', 0, 0, NULL), ('acme/claude-sonnet-4', 0, 0, NULL)) v(id, i, o, r)),
wanted AS (SELECT DISTINCT model FROM (SELECT model FROM raw_e UNION ALL VALUES ('gemini-3.6-flash-high'), ('gemini_3.1_pro_low'), ('x/kimi-k3-turbo')) m WHERE model IS NOT NULL),
peeled AS (SELECT model, lower(trim(model)) AS raw, replace(lower(trim(model)), '_', '-') AS whole, string_split(replace(lower(trim(model)), '_', '-'), '/')[-1] AS c FROM wanted UNION ALL
SELECT model, raw, whole, regexp_replace(c, '(:batch|:free|-high|-tiered|-low|-medium|-xhigh|-fast|-exp|-latest|-preview)$', '') FROM peeled WHERE regexp_matches(c, '...(:batch|:free|-high|-tiered|-low|-medium|-xhigh|-fast|-exp|-latest|-preview)$') AND length(regexp_replace(c, '(:batch|:free|-high|-tiered|-low|-medium|-xhigh|-fast|-exp|-latest|-preview)$', '')) > 3),
lasts AS (SELECT model, raw, whole, arg_min(c, length(c)) AS c FROM peeled GROUP BY ALL),
plain AS (SELECT model, raw, whole, c FROM peeled UNION SELECT model, raw, whole, whole FROM peeled UNION SELECT model, raw, whole, c || '-preview' FROM lasts WHERE contains(c, 'gemini') AND regexp_matches(c, '(^|-)pro$')),
cands AS (SELECT * FROM plain UNION SELECT model, raw, whole, 'google/' || c FROM plain WHERE c LIKE 'gemini%'),
met AS (SELECT model, raw, cat.*, CASE WHEN id = c THEN 3 WHEN slug = string_split(c, '/')[-1] OR slug = c THEN 2 WHEN length(slug) >= 6 AND (contains(c, slug) OR contains(whole, slug)) THEN 1 END AS tier FROM cands CROSS JOIN cat),
scored AS (SELECT *, CASE WHEN i = 0 AND o = 0 THEN 0 ELSE 200 END + 80 + CASE WHEN NOT contains(raw, 'image') THEN 40 ELSE 0 END + CASE WHEN contains(raw, 'preview') = contains(id, 'preview') THEN 30 ELSE 0 END + CASE WHEN (contains(raw, 'gemini') OR raw LIKE 'google/%') AND provider = 'google' THEN 50 ELSE 0 END + least(length(slug), 80) AS score FROM met WHERE tier IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY tier DESC, score DESC, length(slug) DESC) AS k FROM scored)"""


@query(f"WITH RECURSIVE {RAW}, {_CATALOG_SQL} SELECT model, id, i AS input_rate, o AS output_rate, r AS cache_read_rate, CAST(NULL AS DOUBLE) AS cache_write_rate FROM ranked WHERE k = 1")
def catalog_lookup(spark, sf_dir):
    names = raw_usage(spark, sf_dir).select("model").filter("model is not null").distinct()
    extra = spark.createDataFrame([("gemini-3.6-flash-high",), ("gemini_3.1_pro_low",), ("x/kimi-k3-turbo",)], "model string")
    return C.lookup_catalog(names.union(extra), C.parse_catalog(_documents(spark))).drop("long_context")


@query()
def model_catalog(spark, sf_dir):
    return C.model_catalog(C.parse_catalog(_documents(spark)), raw_usage(spark, sf_dir).select("model"), R.rates(spark), R.rates(spark, _CUSTOM))


@query("""WITH n AS (SELECT DISTINCT 'Acme/gemini_' || p_size || '-pro-low-latest' AS model, 'gemini-' || p_size || '-pro' AS p FROM part)
SELECT model, concat_ws(',', 'acme/' || p || '-low-latest', p || '-low-latest', p || '-low', p, p || '-preview', 'google/' || p || '-low-latest', 'google/' || p || '-low', 'google/' || p, 'google/' || p || '-preview') AS candidates FROM n""")
def lookup_candidates(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("Acme/gemini_"), "p_size", F.lit("-pro-low-latest")).alias("model")).distinct()
    return names.select("model", F.concat_ws(",", C.lookup_candidates(F.col("model"))).alias("candidates"))
