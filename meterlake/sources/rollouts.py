"""Rollout logs: counters in the log itself, else the calls that a proxy billed in its turns, else an estimate from its texts; and the table of threads beside them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content, text, time, usage
from ..functions.usage import get, is_object, kind_of
from ..operators import logs
from ..operators import sequences as S
from ..schema import conform
from ..tables import cut
from . import files, sqlite

# Where a row may hold its usage object, in order of trial.
PLACES = [
    "usage", "token_count", "tokenCount", "payload.usage", "payload.token_count", "payload.tokenCount", "payload.info.usage", "payload.info.token_count",
    "payload.info.total_token_usage", "payload.info.last_token_usage", "payload.response.usage", "response.usage", "payload.info.token_usage",
]
# Files of rollouts and of thread tables, and names of a thread's columns.
ROLLOUTS = r"(?:\.jsonl|(?:^|/)rollout-[^/]*)$"
STATES = r"(?i)^(?:state_[^/]*\.sqlite|state\.sqlite|sessions\.db|[^/]*state[^/]*\.db|sqlite/[^/]*\.(?:sqlite|db))$"
PROXY_FILES = r"(?:^|.*/)(?:usage-history|usageHistory|request-details)\.jsonl$"
THREAD = {
    "id": ["id", "#1"],
    "tokens": ["tokens_used", "tokensUsed"],
    "model": ["model"],
    "cwd": ["cwd"],
    "rollout": ["rollout_path", "rolloutPath"],
    "updated": ["updated_at_ms", "updated_at"],
    "created": ["created_at_ms", "created_at"],
}
COUNTS = {f"{n}_tokens": n for n in ("input", "output", "cache_read", "cache_write")}
TURN_CHARS = ("user", "answer", "reasoning", "tool")


def thread_rows(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, mtime, thread, tokens, model, cwd, rollout, ts) of the thread tables below the roots, which are read by ranges of rows."""
    found, _ = sqlite.databases(spark, roots, STATES, 1)
    schema = "_path string, _mtime timestamp, id string, tokens double, model string, cwd string, rollout string, updated string, created string"
    if not found:
        return spark.createDataFrame([], "path string, mtime timestamp, thread string, tokens long, model string, cwd string, rollout string, ts timestamp")
    rows = sqlite.scan(spark, found, "threads", schema, like="thread", unlike="catalog|edge|goal|tool", aliases=json.dumps(THREAD))
    said = F.coalesce("updated", "created")
    early = F.when(said.try_cast("double").between(1e8, 1e9), F.timestamp_seconds(said.try_cast("double")))
    empty_ = lambda c: F.nullif(F.trim(c), F.lit(""))
    rollout = F.regexp_replace(F.trim("rollout"), r"^\\\\\?\\", "")  # an extended path's mark
    return rows.select(
        F.col("_path").alias("path"), F.col("_mtime").alias("mtime"), F.col("id").alias("thread"), F.floor(F.coalesce("tokens", F.lit(0.0)) + 0.5).cast("long").alias("tokens"),
        empty_("model").alias("model"), empty_("cwd").alias("cwd"), F.nullif(rollout, F.lit("")).alias("rollout"), F.coalesce(time.instant(said), time.epoch(said), early, F.col("_mtime")).alias("ts"),
    )


def _plain(path: str) -> Column:
    """A path without its scheme, lower-cased: what files are told apart by."""
    return F.lower(F.regexp_replace(path, "^file:/+", "/"))


def _elsewhere(threads: DataFrame, roots: list[str]) -> list[str]:
    """Rollouts that threads name and the roots' own scan doesn't find; there are few, since agents keep them below."""
    named = threads.filter("rollout is not null").select("rollout").distinct()
    for r in roots:
        below = F.col("rollout").startswith(f"{(sqlite.local_path(r) or r).rstrip('/')}/")
        named = named.filter(~(below & F.col("rollout").rlike(ROLLOUTS)))
    return sorted(r.rollout for r in named.filter(files.not_noise(F.col("rollout"), roots)).collect())


def _told(rows: DataFrame) -> DataFrame:
    """What matters of each row: kind, time, model and folder as known by then, characters by speaker, and objects that may be its usage (JSON, in order of trial)."""
    r, payload = F.col("row"), F.try_variant_get("row", "$.payload", "variant")
    kind = F.coalesce(get(r, "type"), get(r, "event_type"), get(r, "kind"), F.lit(""))
    part, role = F.coalesce(get(r, "payload.type"), F.lit("")), F.coalesce(get(r, "payload.role"), F.lit(""))
    at = lambda p: F.try_variant_get("row", f"$.{p}", "variant")
    hints = kind.contains("token") | kind.contains("usage")
    places = [usage.obj(r, p) for p in PLACES[:-1]] + [F.when(hints & is_object(payload), payload), F.when(hints, r), usage.obj(r, PLACES[-1])]
    item = F.when(kind == "response_item", part)
    said = F.when(item == "message", content.message_chars(at("payload.content"))).when(item == "reasoning", content.message_chars(F.coalesce(at("payload.summary"), at("payload.content")))).when(item == "function_call_output", F.length(get(r, "payload.output")))
    speaker = F.when((item == "message") & (role == "user"), "user").when((item == "message") & (role == "assistant"), "answer").when(item == "reasoning", "reasoning").when(item == "function_call_output", "tool")
    named = lambda v, names: [F.when(kind_of(v, n) == "STRING", get(v, n)) for n in names]
    out = rows.select(
        "path", "mtime", "line_no", kind.alias("kind"), part.alias("part"), usage.time_of(r, payload, fallback=F.col("mtime")).alias("ts"), speaker.alias("speaker"), F.coalesce(said, F.lit(0)).cast("long").alias("chars"),
        usage.model_of(r, payload, at("message")).alias("model"), F.coalesce(*named(r, ["cwd", "workdir", "workspace", "project", "payload.cwd", "payload.workdir", "payload.workspace"])).alias("workspace"),
        F.array_compact(F.array(*[F.to_json(p) for p in places])).alias("places"),
    )
    return S.carry_forward(out, ["path"], "line_no", ["model", "workspace"])


def counted(told: DataFrame) -> DataFrame:
    """Usage that logs state: of a row's objects the first that has tokens; running totals told from single counts."""
    tried = told.filter(~F.col("kind").isin("model_change", "session_meta")).select("path", "line_no", "kind", "ts", "model", "workspace", F.posexplode("places").alias("place", "json"))
    found = usage.with_buckets(tried.withColumn("_v", F.try_parse_json("json")), F.col("_v"))
    first = found.groupBy("path", "line_no", "kind", "ts", "model", "workspace").agg(F.min_by("b", "place").alias("b"))
    flat = first.select("path", "line_no", "kind", "ts", "model", "workspace", *[F.col(f"b.{n}").alias(c) for c, n in COUNTS.items()])
    return S.counter_deltas(flat, "path", "line_no").filter(" + ".join(COUNTS) + " > 0")


def turns_of(told: DataFrame) -> DataFrame:
    """(path, turn, start_ts, end_ts, model, user, answer, reasoning, tool) of completed turns."""
    event = lambda p: (F.col("kind") == "event_msg") & (F.col("part") == p)
    chars = {s: F.when(F.col("speaker") == s, F.col("chars")).otherwise(0) for s in TURN_CHARS}
    return S.turn_segments(told, ["path"], "line_no", event("task_started"), event("task_complete"), chars, last={"model": F.col("model")})


def attributed(windows: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls of a proxy that fall into windows (path, turn, start_ts, end_ts, model, workspace): the first window by file and turn claims a call."""
    numbered = windows.withColumn("seq", F.struct("path", "turn"))
    claims = S.interval_claims(calls.withColumnRenamed("id", "call_id").withColumnRenamed("path", "proxy"), numbered.select("seq", "start_ts", "end_ts", "model"))
    own = numbered.select(F.col("seq").alias("window_seq"), F.col("path"), F.col("model").alias("window_model"), "workspace")
    return claims.join(own, "window_seq")


def read_rollouts(spark: SparkSession, roots: list[str], proxies: list[str] | None = None, agent: str = "codex") -> DataFrame:
    """Usage rows of rollout logs and thread tables below the roots.

    A log without counters is told by the calls of ``proxies`` (folders of
    request histories) in its turns, or in its whole time if it has no turns; where
    no call fits, its turns are estimated from their texts. A thread's total stands
    only where its rollout gave no rows. Rollouts that threads name outside the roots
    are read too.
    """
    threads = cut(thread_rows(spark, roots))
    rows = files.read_json_lines(spark, roots, ROLLOUTS, 12)
    more = _elsewhere(threads, roots)
    if more:
        rows = rows.unionByName(files.read_named_json(spark, more))
    told = cut(_told(rows.filter(files.not_noise(F.col("path"), roots))))
    real = cut(counted(told))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    quiet = told.join(real.select("path").distinct(), "path", "left_anti")
    sessions = quiet.groupBy("path").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max_by("model", "line_no").alias("model"), F.max_by("workspace", "line_no").alias("workspace"))
    turns = cut(turns_of(quiet).withColumnRenamed("model", "turn_model").join(sessions.select("path", "model", "workspace"), "path").withColumn("model", F.coalesce("turn_model", "model")).drop("turn_model"))
    windows = turns.select("path", "turn", "start_ts", "end_ts", "model", "workspace").unionByName(sessions.join(turns.select("path").distinct(), "path", "left_anti").withColumn("turn", F.lit(0).cast("long")))
    out = _rows(real.withColumns({"native": F.concat_ws(":", "line_no", "input_tokens", "output_tokens"), "source_path": F.col("path"), "estimated": F.lit(False), "router_cost": F.lit(None).cast("double")}), agent)

    lines = files.read_lines(spark, proxies or [], PROXY_FILES, 2)
    met = cut(attributed(windows, logs.proxy_rows(lines)))
    via = F.concat_ws(" · ", "workspace", F.lit("via:tokenrouter"))
    claimed = met.select(
        "path", F.lit(None).cast("long").alias("line_no"), F.concat(F.lit("proxy:"), "call_id").alias("native"), F.coalesce(F.nullif("model", F.lit("unknown")), "window_model", F.lit(agent)).alias("model"), "ts", "input_tokens", "output_tokens", zero.alias("cache_read_tokens"), zero.alias("cache_write_tokens"),
        via.alias("workspace"), F.concat("path", F.lit(" ← "), "proxy").alias("source_path"), F.lit(False).alias("estimated"), F.when(F.col("cost") > 0, F.col("cost")).alias("router_cost"),
    )
    tokens = lambda *c: text.tokens_of_chars(sum((F.col(x) for x in c), F.lit(0)))
    guessed = turns.join(met.select("path").distinct(), "path", "left_anti").select(
        "path", F.col("turn").alias("line_no"), F.concat_ws(":", F.lit("est"), F.col("turn").cast("string")).alias("native"), F.coalesce("model", F.lit(agent)).alias("model"), F.col("end_ts").alias("ts"), tokens("user", "tool").alias("input_tokens"), tokens("answer", "reasoning").alias("output_tokens"),
        zero.alias("cache_read_tokens"), zero.alias("cache_write_tokens"), "workspace", F.col("path").alias("source_path"), F.lit(True).alias("estimated"), F.lit(None).cast("double").alias("router_cost"),
    )
    details = out.unionByName(_rows(claimed, agent)).unionByName(_rows(guessed.filter("input_tokens + output_tokens > 0"), agent))
    details = cut(details)
    seen = details.select(_plain("path").alias("rollout")).distinct()
    summaries = threads.filter("tokens > 0").withColumn("rollout", F.coalesce(F.lower("rollout"), F.lit(""))).join(seen, "rollout", "left_anti")
    coarse = summaries.select(
        "path", none.cast("long").alias("line_no"), F.concat_ws(":", F.lit("thread"), "thread", F.col("tokens").cast("string")).alias("native"), F.coalesce("model", F.lit(agent)).alias("model"), "ts", F.col("tokens").alias("input_tokens"), zero.alias("output_tokens"), zero.alias("cache_read_tokens"),
        zero.alias("cache_write_tokens"), F.col("cwd").alias("workspace"), F.col("path").alias("source_path"), F.lit(True).alias("estimated"), F.lit(None).cast("double").alias("router_cost"),
    )
    return conform(details.unionByName(_rows(coarse, agent)).withColumns({"estimated_cost": F.col("router_cost"), "total_tokens": F.expr(" + ".join(COUNTS))}))


def _rows(rows: DataFrame, agent: str) -> DataFrame:
    shown = ["path", "model", "ts", *COUNTS, "workspace", "source_path", "estimated", "router_cost"]
    return rows.select(F.coalesce("line_no", F.lit(0)).alias("seq"), text.stable_id(F.lit(agent), F.col("path"), F.col("native")).alias("id"), F.lit(agent).alias("agent"), *shown)
