"""Rows of routers' logs and of sessions: request records, spend logs, summaries and the attributes of sessions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import time
from ..functions.text import model_from_text, model_specificity, num
from ..functions.usage import fields
from ..schema import conform
from .pricing import first_by
from .reports import is_live

# Where spend logs have the tokens read from a cache, in order of trial.
CACHED_PATHS = ["$.usage_object.prompt_tokens_details.cached_tokens", "$.additional_usage_values.prompt_tokens_details.cached_tokens", "$.usage.prompt_tokens_details.cached_tokens"]
# Names of a request record's fields, in order of trial.
INPUT = ["promptTokens", "prompt_tokens", "inputTokens", "input_tokens"]
OUTPUT = ["completionTokens", "completion_tokens", "outputTokens", "output_tokens"]
PROXY_TIMES = ["timestamp", "ts", "created_at", "createdAt", "time"]
HOT_TIMES = ["timestamp", "createdAt", "created_at", "ts"]


def _opened(lines: DataFrame, names: list[str], inner: list[str]) -> DataFrame:
    """``lines`` with ``o``, an object's fields as text, and ``t``, those of its ``tokens``; both by one parse. Other values have none."""
    rows = lines.withColumn("o", fields(F.col("value"), [*names, "tokens"]))
    return rows.withColumn("t", fields(F.col("o")["tokens"], inner))


def _first(*fields_of: tuple[str, list[str]]) -> Column:
    return F.coalesce(*[F.col(o)[n] for o, names in fields_of for n in names], F.lit(None).cast("string"))


def _time(names: list[str]) -> Column:
    """The first of some fields as a time: text, or a number of seconds or milliseconds."""
    value = _first(("o", names))
    return F.coalesce(time.instant(value), time.epoch(value))


def _with(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with further columns, each computed once: filters on them stay behind the generator."""
    return rows.select(*rows.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).drop("o", "t")


def proxy_rows(lines: DataFrame) -> DataFrame:
    """(id, ts, model, input_tokens, output_tokens, cost, path) of a proxy's request records (path, line_no, value).

    Records without tokens or time are left out; of equal ids the first by path
    and line stays. Values that aren't JSON objects are no records.
    """
    ids, costs = ["id", "request_id", "requestId"], ["cost", "spend", "total_cost"]
    inner = {"input": ["prompt_tokens", "input_tokens"], "output": ["completion_tokens", "output_tokens"]}
    rows = _opened(lines, [*INPUT, *OUTPUT, *PROXY_TIMES, *ids, "model", *costs], sum(inner.values(), []))
    count = lambda names, within: F.greatest(F.lit(0), F.floor(num(_first(("o", names), ("t", within))) + 0.5)).cast("long")
    own = {"own": _first(("o", ids)), "ts": _time(PROXY_TIMES), "model": F.coalesce(F.col("o")["model"], F.get_json_object("value", "$.Model"), F.lit("unknown")), "cost": num(_first(("o", costs)))}
    rows = _with(rows, own | {"input_tokens": count(INPUT, inner["input"]), "output_tokens": count(OUTPUT, inner["output"])}).filter("input_tokens + output_tokens > 0 and ts is not null")
    made = F.concat_ws(":", F.unix_millis("ts").cast("string"), "model", F.col("input_tokens").cast("string"), F.col("output_tokens").cast("string"))
    rows = rows.withColumn("id", F.coalesce("own", made))
    return first_by(rows, ["id"], [F.col("path"), F.col("line_no")]).select("id", "ts", "model", "input_tokens", "output_tokens", "cost", "path")


def hot_rows(lines: DataFrame) -> DataFrame:
    """Usage rows of request records (agent, path, line_no, value) as the live rate needs them, without prices.

    Records without time, tokens and cost are left out; of equal ids the first by
    path and line stays.
    """
    within = {"input": ["prompt_tokens", "promptTokens"], "output": ["completion_tokens", "completionTokens"], "cached": ["cached_tokens", "cache_read_tokens"]}
    own = {"input": ["promptTokens", "prompt_tokens", "inputTokens"], "output": ["completionTokens", "completion_tokens", "outputTokens"], "cached": ["cachedTokens"]}
    costs = ["cost", "estimatedCost", "usd"]
    rows = _opened(lines, [*sum(own.values(), []), *HOT_TIMES, *costs, "id", "model", "provider"], sum(within.values(), []))
    count = lambda k: F.floor(num(_first(("t", within[k]), ("o", own[k])))).cast("long")
    found = {"ts": _time(HOT_TIMES), "input_tokens": count("input"), "output_tokens": count("output"), "cache_read_tokens": count("cached"), "paid": num(_first(("o", costs)))}
    rows = _with(rows, found | {n: F.col("o")[n] for n in ("id", "model", "provider")})
    rows = rows.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens")).filter("ts is not null and (total_tokens > 0 or paid > 0)")
    made = F.concat_ws(":", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.col("input_tokens").cast("string"), F.col("output_tokens").cast("string"))
    rows = rows.withColumns(
        {
            "seq": F.col("line_no"),
            "id": F.concat(F.lit("hotlive:"), "agent", F.lit(":"), F.coalesce("id", made)),
            "cache_write_tokens": F.lit(0),
            "estimated_cost": F.when(F.col("paid") > 0, F.col("paid")),
            "currency": F.lit("USD"),
            "pricing_status": F.when(F.col("paid") > 0, "priced").otherwise("estimated"),
            "workspace": F.concat(F.lit("provider:"), "provider"),
            "source_path": F.col("path"),
            "estimated": F.lit(False),
            "request_count": F.lit(1),
        }
    )
    return conform(first_by(rows, ["id"], [F.col("path"), F.col("line_no")]))


def live_hot_rows(lines: DataFrame, now: datetime, minutes: int = 30) -> DataFrame:
    """Hot rows of single calls of the last ``minutes``; clocks may be ahead a little."""
    at = F.col("ts")
    return hot_rows(lines).filter(is_live() & (at >= time.moment(now - timedelta(minutes=max(1, minutes)))) & (at <= time.moment(now + time.SKEW)))


def spend(logs: DataFrame, *keys: str) -> DataFrame:
    """Requests, tokens and spend by UTC day, or by day and ``keys`` (``model``, ``provider``), of a gateway's spend logs.

    Logs have start_time, model, provider, prompt_tokens, completion_tokens, spend
    and metadata (JSON). Calls without tokens and spend are left out.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    meta = F.try_parse_json("metadata")
    cached = F.coalesce(*[F.try_variant_get(meta, p, "long") for p in CACHED_PATHS], F.lit(0))
    rows = logs.filter((n("prompt_tokens") + n("completion_tokens") > 0) | (n("spend") > 0))
    names = {"model": F.coalesce(F.nullif(F.trim("model"), F.lit("")), F.lit("mixed")), "provider": F.coalesce(F.trim("provider"), F.lit(""))}
    sums = [F.count(F.lit(1)).alias("requests"), *[F.sum(n(c)).alias(c) for c in ("prompt_tokens", "completion_tokens", "spend")], F.greatest(F.sum(cached), F.lit(0)).alias("cached_tokens")]
    return rows.groupBy(F.date_format("start_time", "yyyy-MM-dd").alias("day"), *[names[k].alias(k) for k in keys]).agg(*sums)


def replace_summaries(summaries: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """Detail rows, and the summaries of those threads that have none."""
    return summaries.join(details.select(*keys).distinct(), keys, "left_anti").unionByName(details)


def with_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """``rows`` with workspace and time of their session (session_id, started_at, ended_at, cwd); of repeated sessions the last started counts.

    Rows that have ``ts`` and ``workspace`` keep what they know; the session's fill in.
    """
    at = F.coalesce("ended_at", "started_at")
    one = sessions.filter(F.coalesce("session_id", F.lit("")) != "").groupBy("session_id").agg(F.max_by(F.struct(at.alias("ts"), F.col("cwd").alias("workspace")), F.struct("started_at", "ended_at", "cwd")).alias("s"))
    told = {c: F.coalesce(F.col(c), F.col(f"s.{c}")) if c in rows.columns else F.col(f"s.{c}") for c in ("ts", "workspace")}
    return rows.join(one, "session_id", "left").withColumns(told).select(*rows.columns, *[c for c in told if c not in rows.columns])


def enabled(rows: DataFrame, switched: dict[str, bool]) -> DataFrame:
    """Rows of agents that aren't switched off; agents that aren't named are on."""
    off = [a for a, on in switched.items() if on is False]
    return rows.filter(~F.coalesce(F.col("agent").isin(off), F.lit(False))) if off else rows


def conversation_models(blobs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, model): the most specific model that a conversation's blobs name; of equals the longest, then the first by name. None named, no row."""
    named = blobs.select(key, model_from_text(F.col(text)).alias("model")).filter("model is not null")
    one = named.groupBy(key, "model").agg(F.lit(1).alias("n"))
    best = F.struct((-model_specificity(F.col("model"))).alias("score"), (-F.length("model")).alias("size"), "model")
    return one.groupBy(key).agg(F.min(best)["model"].alias("model"))
