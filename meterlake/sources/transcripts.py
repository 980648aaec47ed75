"""Readers of session transcripts: usage beside messages, counters that run on, and texts whose tokens are estimated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, usage
from ..functions.usage import fields, first_object, get, kind_of
from ..operators import sequences as S
from ..schema import conform
from . import files, generic

JSON = r".*\.jsonl?$"
# Names of counts that are summed, and of rows' parts.
CLAUDE = {
    "input_tokens": ["input_tokens", "inputTokens", "prompt_tokens"],
    "output_tokens": ["output_tokens", "outputTokens", "completion_tokens"],
    "cache_read_tokens": ["cache_read_input_tokens", "cache_read_tokens", "cacheReadTokens"],
    "cache_write_tokens": ["cache_creation_input_tokens", "cache_write_tokens", "cacheWriteTokens"],
}
ANSWERS = ["assistant", "ai", "model", "reasoning", "agent"]
TOTAL = "input_tokens + output_tokens + cache_read_tokens + cache_write_tokens"


def _usage(rows: DataFrame, agent: str, *id_parts) -> DataFrame:
    """Rows with counts, model and ts as usage rows; those without tokens are left out."""
    known = rows.filter(f"{TOTAL} > 0")
    parts = id_parts or (F.col("path"), F.col("line_no"), F.col("input_tokens"), F.col("output_tokens"))
    have = set(rows.columns)
    extra = {"estimated": F.lit(False), "workspace": F.lit(None).cast("string")}
    known = known.withColumns({n: c for n, c in extra.items() if n not in have})
    return conform(known.withColumns({"seq": F.col("line_no"), "id": text.stable_id(F.lit(agent), *parts), "agent": F.lit(agent), "source_path": F.col("path"), "total_tokens": F.expr(TOTAL)}))


def read_claude(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Usage of messages; aliases of a count are summed. The workspace is the folder below ``projects``."""
    rows = files.read_json_lines(spark, roots, r".*\.jsonl$", 10)
    top = rows.withColumn("_r", fields(F.to_json("row"), ["usage", "message", "model", "timestamp", "ts"])).withColumn("_m", fields(F.col("_r.message"), ["usage", "model"]))
    top = top.withColumn("_u", fields(F.coalesce("_m.usage", "_r.usage"), [n for names in CLAUDE.values() for n in names])).filter("_u is not null")
    sums = {c: sum((text.num(F.col(f"_u.{n}")) for n in names), F.lit(0.0)).cast("long") for c, names in CLAUDE.items()}
    said = F.coalesce("_r.timestamp", "_r.ts")
    out = top.select("path", "line_no", *[v.alias(c) for c, v in sums.items()], F.coalesce("_m.model", "_r.model").alias("model"), F.coalesce(usage.time.instant(said), F.col("mtime")).alias("ts"), F.nullif(F.regexp_extract("path", r"/projects/([^/]+)/", 1), F.lit("")).alias("workspace"))
    return _usage(out, "claude-code")


def read_gemini(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Input includes the cache, which is taken off."""
    rows = generic.read_rows(spark, roots, JSON)
    names = ["input_tokens", "inputTokens", "promptTokenCount", "output_tokens", "outputTokens", "candidatesTokenCount", "cached_content_token_count", "cacheReadTokens", "cached"]
    top = rows.withColumn("_j", F.to_json("row")).withColumn("_r", fields(F.col("_j"), ["usage", "tokenUsage", "model", "timestamp", "createdAt"]))
    top = top.withColumn("_u", fields(F.coalesce(first_object(F.col("_r"), ["usage", "tokenUsage"]), F.col("_j")), names))
    n = lambda *which: text.num(F.coalesce(*[F.col(f"_u.{w}") for w in which])).cast("long")
    full, read = n(*names[:3]), n(*names[6:])
    said = F.coalesce("_r.timestamp", "_r.createdAt")
    out = top.select("path", "line_no", F.when((read > 0) & (full >= read), full - read).otherwise(full).alias("input_tokens"), n(*names[3:6]).alias("output_tokens"), read.alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"), F.col("_r.model").alias("model"), F.coalesce(usage.time.instant(said), F.col("mtime")).alias("ts"))
    return _usage(out, "gemini")


def _carried(rows: DataFrame) -> DataFrame:
    """Rows with the last model and folder that their file has named so far."""
    row, message = F.col("row"), F.try_variant_get("row", "$.message", "variant")
    payload = F.try_variant_get("row", "$.payload", "variant")
    named = rows.withColumns({"model": usage.model_of(row, message, payload), "workspace": F.coalesce(*[F.when(kind_of(row, n) == "STRING", get(row, n)) for n in ("cwd", "payload.cwd")])})
    return S.carry_forward(named, ["path"], "line_no", ["model", "workspace"])


def read_carried(spark: SparkSession, roots: list[str], agent: str = "openclaw") -> DataFrame:
    """Usage rows whose model and folder were named in rows before them."""
    rows = _carried(generic.read_rows(spark, roots, JSON))
    kind = F.coalesce(get(F.col("row"), "type"), get(F.col("row"), "role"), get(F.col("row"), "event"), F.lit(""))
    used = rows.filter(~kind.isin("model_change", "session_meta", "system")).withColumn("_u", F.coalesce(*[F.try_variant_get("row", p, "variant") for p in ("$.message.usage", "$.usage", "$.token_usage", "$.message")], F.col("row")))
    out = usage.with_buckets(used, F.col("_u"))
    counts = {f"{n}_tokens": F.col(f"b.{n}") for n in ("input", "output", "cache_read", "cache_write")}
    return _usage(out.select("path", "line_no", "model", "workspace", usage.time_of(F.col("row"), fallback=F.col("mtime")).alias("ts"), *[c.alias(n) for n, c in counts.items()]), agent)


def read_steps(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Transcripts without counts: each answer is estimated from the texts before it and its own."""
    rows = generic.read_rows(spark, roots, JSON)
    r = F.col("row")
    said = F.concat_ws(" ", get(r, "content"), get(r, "thinking"), get(r, "tool_calls"))
    who = F.lower(F.coalesce(get(r, "role"), get(r, "source"), get(r, "type"), F.lit("")))
    talk = rows.withColumns({"text": said, "role": F.when(who.isin(ANSWERS), "assistant").otherwise(who), "ts": usage.time_of(r, fallback=F.col("mtime")), "model": text.model_from_text(said)}).filter("text <> ''")
    named = S.carry_forward(talk, ["path"], "line_no", ["model"]).select("path", "line_no", "ts", "model")
    out = S.context_estimate(talk, ["path"], "line_no").join(named, ["path", "line_no"])
    zero = F.lit(0).cast("long")
    return _usage(out.withColumns({"cache_read_tokens": zero, "cache_write_tokens": zero, "estimated": F.lit(True)}), "antigravity", F.col("path"), F.col("line_no"))
