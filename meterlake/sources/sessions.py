"""Readers of session databases and of encrypted session files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, usage
from ..functions.usage import fields
from ..operators import sequences as S
from ..schema import conform
from . import binary, files, generic, sqlite
from .keyvalues import read_key_values

TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
#: Smaller files hold nothing; below the second size only labelled counts are believed.
LEAST_BYTES, LEAST_GUESSED = 64, 256


def read_trajectories(spark: SparkSession, roots: list[str], key: bytes | None = None) -> DataFrame:
    """One row for each session file: its labelled counts if the key opens it, else an estimate from its size."""
    found = files.read_bytes(spark, roots, r".*\.pb$").filter(F.col("length") >= LEAST_BYTES)
    plain = binary.decrypt(F.col("content"), F.lit(key)) if key else F.lit(None).cast("binary")
    opened = found.select("path", "mtime", "length", plain.alias("plain"))
    counts = opened.select("path", "mtime", "length", binary.dominant_model(F.col("plain")).alias("model"), *[binary.labelled_total(F.col("plain"), f).alias(f) for f in binary.LABELS])
    real = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") > 0
    guess = S.size_estimate(F.col("length"))
    out = counts.withColumn("real", real).filter((F.col("length") >= LEAST_GUESSED) | F.col("real")).withColumns({c: F.when(F.col("real"), F.col(c)).otherwise(guess.get(c, F.lit(0))) for c in binary.LABELS})
    return conform(out.withColumns({"id": text.stable_id(F.lit("windsurf"), F.col("path")), "agent": F.lit("windsurf"), "model": F.coalesce("model", F.lit("windsurf-cascade")), "ts": F.col("mtime"), "source_path": F.col("path"), "estimated": ~F.col("real"), "cache_write_tokens": F.lit(0), "total_tokens": F.expr("input_tokens + output_tokens + cache_read_tokens")}))


# JSON files of an editor that may hold usage, by words in their names or folders.
ARTIFACTS = r"(?i)(?!.*\.lock$)(?:.*\.jsonl|(?:.*/)?[^/]*(?:usage|cascade|chat|transcript|session|token|billing)[^/]*\.json|.*/logs/.*\.(?:json|log)|logs/.*\.(?:json|log)|.*(?:globalstorage|workspacestorage)/.*\.json)$"


def read_cascade(spark: SparkSession, roots: list[str], key: bytes | None = None) -> DataFrame:
    """Usage of an editor's JSON files, of its key-value stores and other tables, and of its session files."""
    files_ = generic.read_usage(spark, roots, "windsurf", ARTIFACTS, 14)
    return files_.unionByName(read_key_values(spark, roots, "windsurf")).unionByName(read_trajectories(spark, roots, key))


def read_sessions(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Usage by session and model, and what sessions count beyond it."""
    tables = sqlite.read_tables(spark, roots, ["sessions", "session_model_usage"])
    names = ["id", "session_id", "model", *TOKENS, "reasoning_tokens", "api_call_count", "cwd", "started_at", "ended_at", "updated_at", "actual_cost_usd", "estimated_cost_usd", "cost_usd", "cost"]
    rows = tables.withColumn("_r", fields(F.col("data"), names))
    n = lambda c: text.num(F.col(f"_r.{c}"))
    paid = F.coalesce(*[F.when(n(c) > 0, n(c)) for c in names[-4:]])
    said = F.coalesce("_r.ended_at", "_r.updated_at", "_r.started_at")
    when = F.coalesce(usage.time.instant(said), usage.time.epoch(said), F.col("mtime"))
    flat = rows.select("path", "name", "line_no", F.coalesce(F.when(F.col("name") == "sessions", F.coalesce("_r.id", "_r.session_id")), F.col("_r.session_id")).alias("sid"), F.col("_r.model").alias("model"), *[n(c).cast("long").alias(c) for c in [*TOKENS, "reasoning_tokens"]], n("api_call_count").cast("long").alias("api_calls"), F.col("_r.cwd").alias("workspace"), when.alias("ts"), paid.alias("cost"))
    flat = flat.withColumn("session_id", F.concat_ws("|", "path", "sid"))
    parts, whole = flat.filter("name = 'session_model_usage'"), flat.filter("name = 'sessions'")
    shown = parts.withColumns({"output_tokens": S.output_with_reasoning(F.col("output_tokens"), F.col("reasoning_tokens"), F.lit("hermes")), "router_cost": F.col("cost"), "estimated": F.lit(False)})
    columns = ["session_id", "model", "ts", "workspace", *TOKENS, "api_calls", "router_cost", "estimated"]
    out = shown.select(columns).unionByName(S.session_gaps(whole, parts).select(columns)).filter(" + ".join(TOKENS) + " > 0")
    return conform(out.withColumns({"id": text.stable_id(F.lit("hermes"), F.col("session_id"), F.col("model"), F.col("estimated")), "agent": F.lit("hermes"), "source_path": F.split_part("session_id", F.lit("|"), F.lit(1)), "request_count": F.nullif("api_calls", F.lit(0)), "estimated_cost": F.col("router_cost"), "total_tokens": F.expr(" + ".join(TOKENS))}))


def read_message_nodes(spark: SparkSession, roots: list[str], newest: int | None = None) -> DataFrame:
    """Messages with usage, or the ``newest`` of each database; JSON lines where there is no database row."""
    stored = sqlite.read_tables(spark, roots, ["message_nodes"]).filter(F.col("data").contains("token"))
    rows = stored.withColumn("_r", fields(F.col("data"), ["data", "content", "message", "created_at"]))
    if newest is not None:
        rows = S.newest(rows.withColumn("_at", F.coalesce(F.col("_r.created_at").try_cast("double"), F.unix_micros(usage.time.instant(F.col("_r.created_at"))).cast("double"))), ["path"], "_at", newest)
    rows = rows.withColumn("row", F.try_parse_json(F.coalesce("_r.data", "_r.message", "_r.content"))).filter("row is not null")
    out = generic.usage_rows(rows.select("path", "mtime", "line_no", "row"), "devin")
    return out if not out.isEmpty() else generic.read_usage(spark, roots, "devin")
