"""Databases, unknown shapes, bundles and damaged documents, made of the tables' rows."""

from __future__ import annotations

import os
import sqlite3
import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions.salvage import salvage
from ..operators import bundles
from ..operators.shapes import usage_within
from ..sources import keyvalues, rollouts, sqlite
from ..tables import shared_dir
from .adapter import table
from .queries import query

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


#: Rows of a made key-value store, so that stores grow in number and not in size.
STORE_ROWS = 100_000


def _folder(spark) -> str:
    """A new folder in the shared place, which tasks must be able to open files in."""
    folder = sqlite.local_path(f"{shared_dir(spark)}/made/{uuid.uuid4().hex}")
    if folder is None:
        raise ValueError("databases are made in a shared folder that is mounted")
    return folder


def _databases(rows, folder: str, name: str, create: str) -> None:
    """Databases in a folder: each task puts its rows into one of its own."""
    marks = ", ".join("?" * len(rows.columns))

    def write(frames):
        os.makedirs(folder, exist_ok=True)
        path, n = f"{folder}/state_{uuid.uuid4().hex}.sqlite", 0
        with sqlite3.connect(f"{path}.tmp") as db:
            db.execute(f"create table {name} ({create})")
            for frame in frames:
                values = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
                n += db.executemany(f"insert into {name} values ({marks})", values).rowcount
        db.close()
        os.replace(f"{path}.tmp", path)  # a task that is run again leaves its first file unfinished
        yield pd.DataFrame({"path": [path], "n": [n]})

    made = rows.mapInPandas(write, "path string, n long").collect()  # one row a task
    wanted = {r.path for r in made}
    for stale in os.listdir(folder):
        if stale.startswith("state_") and f"{folder}/{stale}" not in wanted:
            os.unlink(f"{folder}/{stale}")


@query(
    f"""WITH e AS (SELECT *, {_K} AS k FROM events), t AS (SELECT user_id, CAST(sum(k) AS BIGINT) AS k, count(*) AS n, max(user_id + k) AS most FROM e GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS workspace, CAST(user_id AS BIGINT) AS input_tokens, k AS output_tokens, false AS estimated FROM e WHERE user_id % 3 = 0 AND user_id + k > 0
UNION ALL SELECT CAST(user_id AS VARCHAR), k, 0, true FROM t WHERE k > 0 AND (user_id % 3 <> 0 OR most = 0)"""
)
def thread_scan(spark, sf_dir):
    """A thread for each user, with its total; every third has a rollout of its calls, which then stand instead of the total."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    folder = _folder(spark)
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.col("user_id").cast("string").alias("cwd"), F.struct(F.col("user_id").alias("input_tokens"), F.col("k").alias("output_tokens")).alias("usage")))
    logs = e.groupBy("user_id").agg(F.sum("k").alias("tokens_used"), F.collect_list(F.when(F.col("user_id") % 3 == 0, line)).alias("lines"))

    def write(frames):
        os.makedirs(f"{folder}/sessions", exist_ok=True)
        for frame in frames:
            paths = []
            for user, lines in zip(frame["user_id"], frame["lines"], strict=True):
                paths.append(f"{folder}/sessions/rollout-{user}" if len(lines) else None)
                if len(lines):
                    with open(paths[-1], "w") as out:
                        out.write("\n".join(lines))
            yield pd.DataFrame({"id": frame["user_id"].astype(str), "tokens_used": frame["tokens_used"], "cwd": frame["user_id"].astype(str), "rollout_path": paths})

    threads = logs.mapInPandas(write, "id string, tokens_used long, cwd string, rollout_path string")
    _databases(threads, folder, "threads", "id text primary key, tokens_used integer, cwd text, rollout_path text")
    return rollouts.read_rollouts(spark, [folder]).select("workspace", "input_tokens", "output_tokens", "estimated")


#: Six shapes: an object, an array, messages, deep nesting, a row of another kind, broken text.
_SHAPES = [
    "'{\"input_tokens\":' || user_id || ',\"output_tokens\":' || k || '}'",
    "'[{\"usage\":{\"prompt_tokens\":' || user_id || '}}, 5, [[{\"a\":{\"tokens\":{\"output\":' || k || '}}}]]]'",
    "'{\"messages\":[{\"tokenUsage\":{\"input\":' || user_id || ',\"output\":' || k || '}},{\"x\":null}]}'",
    "'{\"a\":{\"b c\":[{\"d\":{\"e\":{\"f\":{\"g\":[{\"h\":{\"usage\":{\"input_tokens\":' || user_id || '}}}]}}}}]}}'",
    "'{\"name\":\"n\",\"list\":[1,\"2\",{\"usage\":{\"input_tokens\":0}}]}'",
    "'{broken'",
]
_SHAPE = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SHAPES)) + " END"


@query(
    f"""WITH e AS (SELECT event_id, user_id, {_K} AS k FROM events), o AS (
SELECT event_id, '$' AS place, user_id AS i, k AS o FROM e WHERE event_id % 6 = 0
UNION ALL SELECT event_id, '$[0]', user_id, 0 FROM e WHERE event_id % 6 = 1
UNION ALL SELECT event_id, '$[2][0][0].a', 0, k FROM e WHERE event_id % 6 = 1
UNION ALL SELECT event_id, '$.messages[0]', user_id, k FROM e WHERE event_id % 6 = 2
UNION ALL SELECT event_id, '$.a.b c[0].d.e.f.g[0].h', user_id, 0 FROM e WHERE event_id % 6 = 3)
SELECT event_id, place, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens FROM o WHERE i + o > 0"""
)
def usage_shapes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k")).select("event_id", F.try_parse_json(F.expr(_SHAPE)).alias("value"))
    return usage_within(e, ["event_id"]).select("event_id", "place", F.col("b.input").alias("input_tokens"), F.col("b.output").alias("output_tokens"))


@query(
    f"""WITH e AS (SELECT event_id, user_id, {_K} AS k FROM events), o AS (
SELECT event_id, user_id AS i, k AS o FROM e WHERE event_id % 6 IN (0, 2) UNION ALL SELECT event_id, user_id, 0 FROM e WHERE event_id % 6 IN (1, 3) UNION ALL SELECT event_id, 0, k FROM e WHERE event_id % 6 = 1)
SELECT event_id AS seq, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens FROM o WHERE i + o > 0 AND event_id % 4 <> 3"""
)
def kv_usage(spark, sf_dir):
    """Key-value stores; every fourth key says nothing of usage and is left out."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    key = F.concat(F.when(F.col("event_id") % 4 == 3, "window.").otherwise("chat.Usage."), F.col("event_id").cast("string"))
    rows = e.select("event_id", key.alias("key"), F.expr(_SHAPE).alias("value"))
    folder = _folder(spark)
    _databases(rows.repartition(2 + e.count() // STORE_ROWS), folder, "ItemTable", "id integer primary key, key text, value blob")
    return keyvalues.usage_of_values(keyvalues.read_values(spark, [folder], r".*\.sqlite$"), "windsurf").select("seq", "input_tokens", "output_tokens")


_REL = "'m/' || CASE doc_id % 7 WHEN 0 THEN 'usage-history-' || doc_id || '.json' WHEN 1 THEN 'log' || doc_id || '.jsonl' ELSE 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.json' END"
_SIZE = "strlen(coalesce(text, ''))"


@query(
    f"""WITH RECURSIVE f AS (SELECT coalesce(source, '') AS src, {_REL} AS path, {_SIZE} AS size FROM documents), t AS (SELECT *, CASE WHEN contains(path, 'usage-history') OR contains(path, '.jsonl') THEN 'request-level or disallowed' WHEN size > 6000 THEN 'over file cap' END AS reason FROM f),
n AS (SELECT src, path, size, row_number() OVER (PARTITION BY src ORDER BY path) AS k FROM t WHERE reason IS NULL),
w AS (SELECT src, 0 AS k, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS taken FROM (SELECT DISTINCT src FROM n)
UNION ALL SELECT w.src, n.k, CASE WHEN w.total + n.size <= 20000 THEN w.total + n.size ELSE w.total END, CASE WHEN w.total + n.size <= 20000 THEN w.place + 1 ELSE w.place END, CASE WHEN w.total + n.size <= 20000 THEN n.path END FROM w JOIN n ON w.src = n.src AND n.k = w.k + 1)
SELECT t.src, t.path, CAST(t.size AS BIGINT) AS size, coalesce(w.place, 0) AS place, CASE WHEN w.taken IS NULL THEN coalesce(t.reason, 'over total cap') END AS reason FROM t LEFT JOIN w ON t.src = w.src AND w.taken = t.path"""
)
def mirror_bundle(spark, sf_dir):
    """Documents as files of their source's mirror, with limits of 6,000 and 20,000 bytes."""
    rows = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("src"), F.expr(_REL.replace("VARCHAR", "STRING")).alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return bundles.bundle(rows, ["src"], most_file=6000, most_total=20_000).withColumn("place", F.coalesce("place", F.lit(0)).cast("long"))


@query(f"SELECT event_id, user_id, {_K} AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) x WHERE i < n")
def salvaged_objects(spark, sf_dir):
    """An array of each user's events, cut off within its last object; strings hold braces, quotes and backslashes."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    one = F.to_json(F.struct("event_id", F.lit('a } " \\ { b').alias("text"), F.struct("user_id", "k").alias("in")))
    docs = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", one.alias("j")))).alias("rows"))
    cut = docs.select(F.concat(F.lit("["), F.array_join("rows.j", ", ")).alias("text")).select(F.col("text").substr(F.lit(1), F.length("text") - 2).alias("text"))
    found = cut.select(F.explode(salvage(F.col("text"))).alias("j"))
    return found.select(F.get_json_object("j", "$.event_id").cast("long").alias("event_id"), F.get_json_object("j", "$.in.user_id").cast("long").alias("user_id"), F.get_json_object("j", "$.in.k").cast("long").alias("k"))
