"""Session folders that hold a stream of updates, a summary and a chat: usage from the first of them that tells any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content, text, time, usage
from ..functions.usage import fields, get
from ..operators import sequences as S
from ..schema import conform
from ..tables import cut
from . import files

# Names of counts, in order of trial, and of rows' kinds.
IN = ["inputTokens", "input_tokens", "prompt_tokens", "promptTokens"]
OUT = ["outputTokens", "output_tokens", "completion_tokens", "completionTokens"]
REASONING = ["reasoningTokens", "reasoning_tokens", "thinking_tokens"]
READ = ["cachedReadTokens", "cache_read_input_tokens", "cacheReadInputTokens", "cache_read_tokens", "cacheReadTokens", "cached_tokens"]
WRITE = ["cacheCreationTokens", "cache_creation_tokens", "cache_creation_input_tokens", "cacheWriteTokens", "cache_write_tokens", "cachedWriteTokens"]
TICKS = ["costUsdTicks", "cost_usd_ticks"]
CONTEXT, ANSWERS, ASKING = ["user", "human", "system", "tool_result", "tool"], ["assistant", "ai", "model", "reasoning"], ["user", "human", "system"]
CHUNK = "agent_thought_chunk|agent_message_chunk|AgentThoughtChunk|AgentMessageChunk"
DEFAULT_MODEL = "grok-4.5"
COUNTS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]


def _folder(path: str = "path") -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _first(row: Column, names: list[str]) -> Column:
    return text.num(F.coalesce(*[row[n] for n in names])).cast("long")


def counts_of(u: Column) -> dict[str, Column]:
    """Counts of a usage object's fields: cached input apart, reasoning within the output, the cost in ticks."""
    into, read = _first(u, IN), _first(u, READ)
    return {
        "input_tokens": S.uncached(into, read),
        "output_tokens": F.greatest(_first(u, OUT), _first(u, REASONING)),
        "cache_read_tokens": read,
        "cache_write_tokens": _first(u, WRITE),
        "estimated_cost": F.nullif(S.of_ticks(_first(u, TICKS)), F.lit(0.0)),
    }


def _counted(rows: DataFrame, json: Column) -> DataFrame:
    """``rows`` with counts of a usage object (JSON text); those without tokens are left out."""
    named = rows.withColumn("_u", fields(json, [*IN, *OUT, *REASONING, *READ, *WRITE, *TICKS]))
    return named.withColumns(counts_of(F.col("_u"))).drop("_u").filter(" + ".join(COUNTS) + " > 0")


def sessions(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(folder, session, model, workspace, said, usage) of session folders with a summary; damaged summaries say nothing."""
    found = files.read_documents(spark, roots, r"(^|/)summary\.json$", 14).select(_folder().alias("folder"), F.col("path").alias("summary"), F.col("mtime").alias("summary_mtime"), F.try_parse_json("value").alias("s"))
    s = F.col("s")
    named = lambda *names: F.coalesce(*[F.nullif(F.when(usage.kind_of(s, n) == "STRING", get(s, n)), F.lit("")) for n in names])
    told = F.coalesce(usage.obj(s, "usage"), usage.obj(s, "token_usage"))
    return found.select("folder", "summary", "summary_mtime", named("info.id").alias("session"), named("current_model_id", "model").alias("model"), named("info.cwd", "git_root_dir").alias("workspace"), time.instant(named("updated_at", "last_active_at", "created_at")).alias("said"), F.to_json(told).alias("usage"))


def _model_used(row: Column) -> Column:
    """Of the models that a turn used the one with most tokens, the first of equals; null if it names none."""
    used = F.map_entries(F.try_variant_get(row, "$.params.update.usage.modelUsage", "map<string, variant>"))
    size = lambda m: text.num(F.coalesce(get(m, "totalTokens"), get(m, "inputTokens")))
    start = F.struct(F.lit(None).cast("string").alias("model"), F.lit(-1.0).alias("size"))
    return F.aggregate(used, start, lambda best, e: F.when(size(e["value"]) > best["size"], F.struct(e["key"].alias("model"), size(e["value"]).alias("size"))).otherwise(best))["model"]


def _stream(lines: DataFrame) -> DataFrame:
    """What each line of an update stream tells: prompt, totals seen, characters that the model wrote, and whether a turn ended with what usage."""
    v = F.col("value")
    found = lambda *names: F.coalesce(*[F.nullif(F.regexp_extract(v, rf'"{n}"\s*:\s*(\d+)', 1), F.lit("")) for n in names]).cast("long")
    prompt = F.coalesce(*[F.nullif(F.regexp_extract(v, rf'"{n}"\s*:\s*"([^"]+)"', 1), F.lit("")) for n in ("promptId", "prompt_id")])
    row = F.when(v.contains("turn_completed") | v.contains('"tool_call"'), F.try_parse_json(v))
    told = lines.withColumn("_row", row)
    r = F.col("_row")
    raw = F.try_variant_get(r, "$.params.update.rawInput", "variant")
    arguments = F.when(usage.kind_of(r, "params.update.rawInput") == "STRING", F.length(F.try_variant_get(raw, "$", "string"))).otherwise(F.coalesce(F.length(F.nullif(F.to_json(raw), F.lit("null"))), F.length(get(r, "params.update.title"))))
    chunk = F.aggregate(F.regexp_extract_all(v, F.lit(r'"text"\s*:\s*"((?:\\.|[^"\\])*)"'), F.lit(1)), F.lit(0), lambda a, x: a + F.length(x))
    wrote = F.when(v.rlike(CHUNK), chunk).otherwise(0) + F.when(v.rlike(r'"sessionUpdate"\s*:\s*"tool_call"(?![_a-zA-Z])'), F.coalesce(arguments, F.lit(0))).otherwise(0)
    done = F.coalesce(get(r, "params.update.sessionUpdate") == "turn_completed", F.lit(False))
    ended = F.when(done, F.coalesce(time.epoch(get(r, "timestamp")), time.instant(get(r, "timestamp"))))
    own = F.when(done, F.coalesce(F.nullif(get(r, "params.update.prompt_id"), F.lit("")), F.nullif(get(r, "params.update.promptId"), F.lit(""))))
    return told.select(
        "path", "mtime", "line_no", _folder().alias("folder"), F.coalesce(own, prompt).alias("prompt"), own.alias("own"), F.coalesce(found("totalTokens"), F.lit(0)).alias("total"), F.coalesce(found("cachedReadTokens", "cached_tokens", "cache_read_tokens"), F.lit(0)).alias("cached"),
        wrote.cast("long").alias("chars"), done.alias("done"), ended.alias("ended"), F.when(done, F.to_json(usage.obj(r, "params.update.usage"))).alias("usage"), F.when(done, _model_used(r)).alias("model"), F.when(done, get(r, "params.sessionId")).alias("session"),
    )


def _of_peaks(rows: DataFrame) -> DataFrame:
    """Counts estimated from peak_total, peak_cached and output_chars; rows without any are left out."""
    some = rows.filter("peak_total > 0 or peak_cached > 0 or output_chars > 0")
    read = F.least("peak_cached", F.coalesce(F.nullif("peak_total", F.lit(0)), "peak_cached"))
    zero = F.lit(0).cast("long")
    return some.withColumns({"cache_read_tokens": read, "input_tokens": F.greatest(zero, F.coalesce(F.nullif("peak_total", F.lit(0)), read) - read), "output_tokens": text.tokens_of_chars(F.col("output_chars")).cast("long"), "cache_write_tokens": zero, "estimated_cost": F.lit(None).cast("double"), "estimated": F.lit(True)})


SHOWN = ["folder", "path", "mtime", "line_no", "key", "model", "ended", *COUNTS, "estimated_cost", "estimated"]


def of_updates(told: DataFrame) -> DataFrame:
    """Usage of streams: of turns that state it; of other turns, ended or going on, the peak of what the stream showed; of streams without prompts, their greatest totals."""
    ends = told.filter("done").withColumn("key", F.coalesce("own", F.concat(F.lit("#"), F.col("line_no").cast("string"))))
    real = _counted(ends, F.col("usage")).withColumn("estimated", F.lit(False))
    told_ = told.filter("prompt is not null")
    peaks = S.prompt_peaks(told_, ["folder", "prompt"], "line_no", F.col("done"), "total", "cached", "chars")
    stated = real.select("folder", F.col("key").alias("prompt")).distinct()
    silent = ends.select("folder", "path", "mtime", "line_no", F.col("key").alias("prompt"), "ended").join(stated, ["folder", "prompt"], "left_anti")
    silent = silent.groupBy("folder", "prompt").agg(F.min_by(F.struct("path", "mtime", "line_no", "ended"), "line_no").alias("e")).select("folder", "prompt", "e.*")
    last = told.groupBy("folder").agg(F.max("path").alias("path"), F.max("mtime").alias("mtime"), F.max("line_no").alias("line_no"), F.max_by("ended", F.when(F.col("done"), F.col("line_no"))).alias("ended"))
    going = peaks.join(ends.select("folder", F.col("key").alias("prompt")).distinct(), ["folder", "prompt"], "left_anti").join(last, "folder")
    guessed = _of_peaks(peaks.join(silent, ["folder", "prompt"])).unionByName(_of_peaks(going), allowMissingColumns=True)
    guessed = guessed.withColumns({"key": F.col("prompt"), "model": F.lit(None).cast("string")})
    out = cut(real.select(SHOWN).unionByName(guessed.select(SHOWN)))
    floors = told.filter("not done").groupBy("folder").agg(F.max("total").alias("peak_total"), F.max("cached").alias("peak_cached"), F.lit(0).cast("long").alias("output_chars"))
    floors = _of_peaks(floors.join(out.select("folder").distinct(), "folder", "left_anti").join(last, "folder")).withColumns({"key": F.lit("floor"), "model": F.lit(None).cast("string")})
    return out.unionByName(floors.select(SHOWN))


def of_chats(spark: SparkSession, roots: list[str], without: DataFrame) -> DataFrame:
    """Estimates from chats of folders that aren't in ``without``: an answer's input is all text before it; of chats without answers, all text at once."""
    rows = files.read_json_lines(spark, roots, r"(^|/)chat_history\.jsonl$", 14)
    r = F.col("row")
    said = F.coalesce(*[F.when(usage.kind_of(r, n) == "STRING", time.instant(get(r, n))) for n in ("timestamp", "created_at", "ts")])
    talk = rows.select(_folder().alias("folder"), "path", "mtime", "line_no", F.coalesce(get(r, "type"), get(r, "role"), F.lit("")).alias("who"), content.message_text(F.try_variant_get("row", "$.content", "variant")).alias("text"), said.alias("ended"))
    talk = cut(talk.join(without, "folder", "left_anti").filter((F.col("text") != "") & F.col("who").isin([*CONTEXT, *ANSWERS])).withColumn("role", F.when(F.col("who").isin(ANSWERS), "assistant").otherwise("other")))
    zero = F.lit(0).cast("long")
    fixed = {"cache_read_tokens": zero, "cache_write_tokens": zero, "estimated_cost": F.lit(None).cast("double"), "estimated": F.lit(True), "model": F.lit(None).cast("string")}
    turns = S.context_estimate(talk, ["folder"], "line_no").filter("input_tokens + output_tokens > 0").join(talk.select("folder", "path", "mtime", "line_no", "ended"), ["folder", "line_no"])
    turns = turns.withColumns(fixed | {"key": F.concat_ws(":", F.lit("turn"), "line_no", "input_tokens", "output_tokens")})
    chars = lambda who: F.sum(F.when(F.col("who").isin(who), F.length("text")).otherwise(0))
    whole = talk.join(turns.select("folder").distinct(), "folder", "left_anti").groupBy("folder").agg(F.max("path").alias("path"), F.max("mtime").alias("mtime"), F.max("line_no").alias("line_no"), chars(ASKING).alias("i"), chars(ANSWERS).alias("o")).filter("i + o > 0")
    whole = whole.withColumns(fixed | {"input_tokens": text.tokens_of_chars(F.col("i")).cast("long"), "output_tokens": text.tokens_of_chars(F.col("o")).cast("long"), "key": F.lit("est"), "ended": F.lit(None).cast("timestamp")})
    return turns.select(SHOWN).unionByName(whole.select(SHOWN))


def read_updates(spark: SparkSession, roots: list[str], agent: str = "grok") -> DataFrame:
    """Usage rows of session folders: of the update stream, else of the summary, else estimated from the chat."""
    told = cut(_stream(files.read_lines(spark, roots, r"(?:^|.*/)updates\.jsonl$", 14)))
    known = cut(sessions(spark, roots))
    streamed = cut(of_updates(told))
    stated = known.filter("usage is not null").join(streamed.select("folder").distinct(), "folder", "left_anti")
    stated = _counted(stated.select("folder", F.col("summary").alias("path"), F.col("summary_mtime").alias("mtime"), F.lit(0).cast("long").alias("line_no"), F.lit("usage").alias("key"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("timestamp").alias("ended"), F.lit(False).alias("estimated"), "usage"), F.col("usage")).select(SHOWN)
    out = streamed.unionByName(stated)
    out = out.unionByName(of_chats(spark, roots, out.select("folder").distinct()))
    named = told.filter("session is not null").groupBy("folder").agg(F.max("session").alias("named"))
    met = out.join(known.select("folder", "session", F.col("model").alias("usual"), "workspace", "said"), "folder", "left").join(named, "folder", "left")
    session = F.coalesce("session", "named", F.element_at(F.split("folder", "/"), -1))
    shown = met.select(
        F.col("line_no").alias("seq"), text.stable_id(F.lit(agent), session, F.lit("tc"), F.col("key")).alias("id"), F.lit(agent).alias("agent"), F.coalesce("model", "usual", F.lit(DEFAULT_MODEL)).alias("model"), F.coalesce("ended", "said", "mtime").alias("ts"), *COUNTS, "estimated_cost",
        F.coalesce("workspace", content.workspace_of(F.regexp_replace("folder", "^file:/+", "/"))).alias("workspace"), F.col("path").alias("source_path"), "estimated",
    )
    return conform(shown.withColumn("total_tokens", F.expr(" + ".join(COUNTS))))
