"""Deduplication and reconciliation in SQL: each function takes a relation and returns a subquery."""

from __future__ import annotations

from .adapter import NOW_SQL, norm_sql

COLS = "seq, id, agent, model, ts, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, total_tokens, estimated_cost, workspace, source_path, estimated, request_count"
ROUTER = "agent IN ('9router', 'xlabrouter', 'routerlab', 'litellm')"
COST = "coalesce(estimated_cost, 0)"
REQ = "CASE WHEN request_count > 0 THEN request_count ELSE 1 END"
DAY = "strftime(ts, '%Y-%m-%d')"
PATH = r"lower(replace(source_path, '\', '/'))"
RICH = f"estimated, total_tokens DESC, (model IS NOT NULL AND trim(model) <> '') DESC, {COST} DESC"
GHOST = "(estimated AND coalesce(output_tokens, 0) <= 0)"


def richest(src: str, key: str, order: str = f"{RICH}, seq", where: str = "true") -> str:
    return f"(SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {src} WHERE {where}) WHERE rn = 1)"


def richer_union(*parts: str) -> str:
    union = " UNION ALL ".join(f"SELECT {COLS}, {i} AS part FROM {p}" for i, p in enumerate(parts))
    return richest(f"({union})", "id", f"{RICH}, part, seq")


def exact(src: str) -> str:
    stamp = f"CASE WHEN {ROUTER} THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"
    only = lambda c: f"CASE WHEN {ROUTER} THEN NULL ELSE {c} END"
    return richest(src, f"agent, {stamp}, coalesce(model, ''), input_tokens, output_tokens, {only('cache_read_tokens')}, {only('cache_write_tokens')}, CASE WHEN {ROUTER} THEN coalesce(workspace, '') ELSE coalesce(source_path, '') END")


def stale(src: str) -> str:
    return f"""(WITH x AS MATERIALIZED (SELECT {COLS}, {GHOST} AS ghost, CASE WHEN agent = 'grok' AND {PATH} LIKE '%updates.jsonl' THEN {PATH} END AS p FROM {src}),
b AS (SELECT p, bool_or(NOT ghost) AS better, first(id ORDER BY total_tokens DESC, seq) FILTER (WHERE ghost) AS best FROM x WHERE p IS NOT NULL GROUP BY p)
SELECT {COLS} FROM x LEFT JOIN b USING (p) WHERE p IS NULL OR NOT ghost OR (NOT better AND id = best))"""


def by_file(src: str) -> str:
    one = f"coalesce(agent = 'windsurf' AND {PATH} LIKE '%.pb', false)"
    return f"(WITH f AS MATERIALIZED (SELECT {COLS} FROM {src}) SELECT * FROM " + stale(f"(SELECT {COLS} FROM f WHERE NOT {one} UNION ALL SELECT {COLS} FROM {richest('f', PATH, where=one)})") + ")"


def mixed(src: str) -> str:
    """Without the mixed rollups of an agent's day that its models explain; ``src`` also has day, m and w."""
    named = "m NOT IN ('mixed', 'unknown')"
    return f"""(WITH r AS MATERIALIZED (SELECT * FROM {src}), s AS (SELECT agent, day, sum(CASE WHEN {named} THEN total_tokens ELSE 0 END) AS mt, sum(CASE WHEN {named} THEN {COST} ELSE 0 END) AS mc, bool_or({named}) AS named FROM r GROUP BY 1, 2)
SELECT r.* FROM r JOIN s USING (agent, day) WHERE {named} OR NOT named OR NOT ((total_tokens > 0 AND mt >= total_tokens * 0.95e0) OR ({COST} > 0 AND mc >= {COST} * 0.95e0 AND mt >= total_tokens * 0.9e0)))"""


CHOICE = """CASE WHEN dn = 0 THEN 'requests' WHEN qn = 0 THEN 'rollups' WHEN qn >= 20 AND dt > 0 AND qt >= greatest(dt * 2, dt + 50000) THEN 'both'
WHEN qn >= 20 AND dt > 0 AND qt >= dt * 0.9e0 AND qt <= dt * 1.35e0 AND (dr <= 0 OR (qr >= dr * 0.75e0 AND qr <= greatest(dr * 1.25e0, dr + 10))) THEN CASE WHEN qt < dt * 0.98e0 THEN 'filled' ELSE 'requests' END
WHEN (dr > 0 AND dt > 0 AND qr > greatest(dr * 1.5e0, dr + 5) AND qt <= dt * 1.05e0 AND qt >= dt * 0.5e0) OR (sure AND ((dt > 0 AND qt > dt * 1.05e0) OR (dc > 0 AND qc > dc * 1.15e0 AND qt >= dt * 0.9e0))) THEN 'rollups'
WHEN NOT sure AND qt > dt THEN 'requests' WHEN dt > 0 AND qt >= dt * 0.95e0 AND qt <= dt * 1.05e0 AND (dr <= 0 OR qr <= greatest(dr * 1.25e0, dr + 3)) THEN 'requests'
WHEN qn >= 2 AND (qn >= 20 OR qt >= dt * 0.15e0 OR (dr > 0 AND qr >= dr * 0.15e0) OR qn > dn) AND qt < dt * 0.98e0 THEN 'filled' ELSE 'rollups' END"""


def router_days(src: str) -> str:
    sums = lambda k, where: f"count(*) FILTER (WHERE {where}) AS {k}n, coalesce(sum(total_tokens) FILTER (WHERE {where}), 0) AS {k}t, coalesce(sum({COST}) FILTER (WHERE {where}), 0) AS {k}c, coalesce(sum({REQ}) FILTER (WHERE {where}), 0) AS {k}r"
    own = "CASE WHEN w = '' THEN 'id:' || id ELSE 'mw:' || m || '|' || w END"
    part = lambda c: f"greatest(0, CAST(floor({c} * ratio) AS BIGINT))"
    keyed = f"{COLS}, day, m, w"
    rich = f"(SELECT {keyed} FROM (SELECT *, row_number() OVER (PARTITION BY agent, day, {own} ORDER BY {RICH}, seq) AS rn FROM rk WHERE estimated) WHERE rn = 1)"
    return f"""(WITH a AS MATERIALIZED (SELECT {COLS} FROM {src}),
rk AS MATERIALIZED (SELECT *, {DAY} AS day, coalesce(nullif(trim(model), ''), 'mixed') AS m, coalesce(trim(workspace), '') AS w FROM a WHERE {ROUTER} AND ts IS NOT NULL),
cl AS MATERIALIZED (SELECT {keyed} FROM {mixed(rich)} UNION ALL SELECT {keyed} FROM rk WHERE NOT estimated),
su AS (SELECT agent, day, {sums('d', 'estimated')}, {sums('q', 'NOT estimated')} FROM cl GROUP BY 1, 2),
ch AS MATERIALIZED (SELECT agent, day, {CHOICE} AS choice FROM (SELECT *, dr >= 10 OR dt >= 100000 OR (dc > 0 AND dt >= 10000) AS sure FROM su)),
jo AS MATERIALIZED (SELECT cl.*, choice FROM cl JOIN ch USING (agent, day)),
f AS (SELECT agent, day, m, w, sum({REQ}) AS n, sum(total_tokens) AS t, sum({COST}) AS c FROM jo WHERE choice = 'filled' AND NOT estimated GROUP BY 1, 2, 3, 4),
g AS (SELECT agent, day, m, sum({REQ}) AS n, sum(total_tokens) AS t, sum({COST}) AS c FROM jo WHERE choice = 'filled' AND NOT estimated GROUP BY 1, 2, 3),
h AS (SELECT jo.*, CASE WHEN f.n IS NOT NULL THEN f.n ELSE coalesce(g.n, 0) END AS hn, CASE WHEN f.n IS NOT NULL THEN f.t ELSE coalesce(g.t, 0) END AS ht, CASE WHEN f.n IS NOT NULL THEN f.c ELSE coalesce(g.c, 0) END AS hc
  FROM jo LEFT JOIN f USING (agent, day, m, w) LEFT JOIN g USING (agent, day, m) WHERE choice = 'filled' AND estimated),
r AS (SELECT *, greatest(0, total_tokens - ht) AS rt, greatest(0, {COST} - hc) AS rc, greatest(0, {REQ} - hn) AS rr, CASE WHEN total_tokens > 0 THEN greatest(0, total_tokens - ht) / total_tokens ELSE 0 END AS ratio FROM h),
p AS (SELECT *, {part('input_tokens')} AS p1, {part('output_tokens')} AS p2, {part('cache_read_tokens')} AS p3, {part('cache_write_tokens')} AS p4 FROM r WHERE NOT ((rt <= 0 AND rc <= 0 AND rr <= 0) OR (ht >= total_tokens AND hn >= {REQ} AND total_tokens > 0))),
n AS (SELECT *, rt > 0 AND p1 + p2 + p3 + p4 > rt AS over FROM p),
o AS (SELECT *, CASE WHEN rt <= 0 THEN p1 WHEN over THEN rt ELSE rt - p2 - p3 - p4 END AS n1, CASE WHEN over THEN 0 ELSE p2 END AS n2, CASE WHEN over THEN 0 ELSE p3 END AS n3, CASE WHEN over THEN 0 ELSE p4 END AS n4 FROM n)
SELECT {COLS} FROM a WHERE NOT ({ROUTER} AND ts IS NOT NULL) UNION ALL
SELECT {COLS} FROM jo WHERE CASE WHEN estimated THEN choice IN ('rollups', 'both') ELSE choice IN ('requests', 'both', 'filled') END UNION ALL
SELECT seq, 'gapfill:' || agent || ':' || day || ':' || m || ':' || CASE WHEN w = '' THEN 'nows' ELSE w END AS id, agent, model, ts, CAST(n1 AS BIGINT), CAST(n2 AS BIGINT), CAST(n3 AS BIGINT), CAST(n4 AS BIGINT), CAST(CASE WHEN n1 + n2 + n3 + n4 > 0 THEN n1 + n2 + n3 + n4 ELSE rt END AS BIGINT), rc, workspace,
  coalesce(nullif(source_path, ''), 'gapfill-daily'), true, CAST(CASE WHEN rr > 0 THEN rr WHEN n1 + n2 + n3 + n4 > 0 THEN 1 ELSE 0 END AS BIGINT) FROM o WHERE n1 + n2 + n3 + n4 > 0 OR rc > 0 OR rr > 0)"""


def heal(src: str) -> str:
    return exact(by_file(router_days(src)))


def monotonic(old: str, new: str) -> str:
    ghost = f"coalesce(agent = 'grok' AND {GHOST} AND {PATH} LIKE '%updates.jsonl', false)"
    sums = f"count(*) FILTER (WHERE NOT estimated) AS live, count(*) FILTER (WHERE estimated AND output_tokens > 0) AS guess, sum(CASE WHEN {ghost} THEN 0 ELSE total_tokens END) AS tok, sum({COST}) AS cost, sum({REQ}) AS req, count(*) AS n"
    side = lambda s: f"(SELECT *, coalesce({DAY}, 'id:' || id) AS b FROM (SELECT * REPLACE (CASE WHEN agent IN ('xlabrouter', 'xlrouter', 'xlab-router', 'xlab_router') THEN 'routerlab' ELSE lower(trim(agent)) END AS agent) FROM {stale(s)}))"
    keep = """CASE WHEN n.n IS NULL THEN true WHEN p.n IS NULL THEN false WHEN p.live <> n.live THEN p.live > n.live WHEN p.guess <> n.guess THEN p.guess > n.guess WHEN p.tok > n.tok * 1.001e0 THEN true WHEN n.tok > p.tok * 1.001e0 THEN false
WHEN p.cost > n.cost * 1.001e0 THEN true WHEN n.cost > p.cost * 1.001e0 THEN false WHEN p.req <> n.req THEN p.req > n.req ELSE p.n >= n.n END"""
    body = f"""(WITH o AS MATERIALIZED (SELECT * FROM {side(old)}), w AS MATERIALIZED (SELECT * FROM {side(new)}), p AS (SELECT agent, b, {sums} FROM o GROUP BY 1, 2), n AS (SELECT agent, b, {sums} FROM w GROUP BY 1, 2),
c AS MATERIALIZED (SELECT agent, b, {keep} AS old FROM p FULL JOIN n USING (agent, b)) SELECT {COLS} FROM o JOIN c USING (agent, b) WHERE c.old UNION ALL SELECT {COLS} FROM w JOIN c USING (agent, b) WHERE NOT c.old)"""
    return stale(body)


ROLLUP = "coalesce(starts_with(source_path, 'backup:gist'), false)"


def clean(x: str) -> str:
    return f"coalesce(nullif(substr(regexp_replace(regexp_replace(trim({x}), '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), ''), 'unknown')"


_NAME = r"coalesce(nullif(trim(regexp_extract(source_path, '^backup:gist-(?:hour|daily):(.*)$', 1)), ''), CASE WHEN " + ROLLUP + " THEN nullif(trim(workspace), '') END)"
MACHINE = f"CASE WHEN {_NAME} IS NOT NULL THEN {clean(_NAME)} END"


def tiered(src: str, machine: str) -> str:
    hour = f"ts >= {NOW_SQL} - INTERVAL 8 DAY"
    return f"""(SELECT CAST(NULL AS BIGINT) AS seq, substr(sha256(CASE WHEN h THEN 'gist-hour' ELSE 'gist-daily' END || '|{machine}|' || b || '|' || agent || '|' || coalesce(model, 'unknown')), 1, 24) AS id, agent, model, max(ts) AS ts, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum({COST}) AS estimated_cost, '{machine}' AS workspace,
CASE WHEN h THEN 'backup:gist-hour:{machine}' ELSE 'backup:gist-daily:{machine}' END AS source_path, true AS estimated, CAST(NULL AS BIGINT) AS request_count
FROM (SELECT * REPLACE (lower({norm_sql("model")}) AS model), {hour} AS h, CASE WHEN {hour} THEN strftime(ts, '%Y-%m-%dT%H') ELSE {DAY} END AS b FROM {src} WHERE NOT {ROLLUP} AND ts IS NOT NULL) GROUP BY agent, model, h, b)"""


def uncovered(local: str, imported: str, machine: str) -> str:
    key = f"coalesce({DAY}, '') || '|' || agent || '|' || coalesce(lower({norm_sql('model')}), '')"
    return f"(SELECT {COLS} FROM {imported} i WHERE NOT ({ROLLUP} AND coalesce({MACHINE}, '{machine}') = '{machine}' AND {key} IN (SELECT {key} FROM {local} WHERE NOT {ROLLUP})))"
