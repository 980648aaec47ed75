"""Token counts, model and time from usage objects whose field names vary.

Objects are VARIANT values. Of several names the first that holds a value wins,
and only then is the value made a number: a later name does not stand in for
text that isn't a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text, time

# Names under which logs hold the counts, in order of trial.
NESTED = ["usage", "token_usage", "tokenUsage", "tokens", "token_count", "metrics", "metadata.metrics"]
INPUT = ["input_tokens", "inputTokens", "prompt_tokens", "promptTokens", "prompt_token_count", "input", "total_input_tokens", "input_other"]
OUTPUT = ["output_tokens", "outputTokens", "completion_tokens", "completionTokens", "candidatesTokenCount", "output", "total_output_tokens", "completion"]
CACHE_READ = [
    "cache_read_input_tokens", "cache_read_tokens", "cacheReadTokens", "cachedReadTokens", "cacheReadInputTokens", "cache_read", "cached_tokens", "cachedTokens",
    "cached_content_token_count", "cachedContentTokenCount", "cached", "input_cache_read", "total_cache_read_tokens",
]
CACHE_WRITE = ["cache_creation_input_tokens", "cache_write_tokens", "cacheWriteTokens", "cache_write", "cache_creation_tokens", "cachedWriteTokens", "input_cache_creation", "total_cache_write_tokens"]
DETAILS = ["prompt_tokens_details", "promptTokensDetails", "input_tokens_details"]
DETAIL_READ = ["cached_tokens", "cache_read_tokens", "cachedTokens", "cache_read_input_tokens"]
DETAIL_WRITE = ["cache_write_tokens", "cache_creation_input_tokens"]
MODEL = ["model", "modelId", "model_id", "model_name", "rawModel"]
TIME = ["timestamp", "ts", "created_at", "createdAt", "started_at", "startedAt", "completed_at", "completedAt", "time", "date", "mtime"]


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def kind_of(v: Column, path: str | None = None) -> Column:
    """What a field holds: OBJECT, ARRAY, STRING, a number's kind, or null."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant") if path else v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind_of(v).startswith("OBJECT"), F.lit(False))


def obj(v: Column, path: str) -> Column:
    """A field if it holds an object, else null."""
    x = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(is_object(x), x)


def first_of(v: Column, names: list[str]) -> list[Column]:
    return [get(v, n) for n in names]


def fields(json: Column, names: list[str]) -> Column:
    """A struct of an object's fields as text, by one parse; objects within stay JSON."""
    return F.from_json(json, ", ".join(f"`{n}` string" for n in dict.fromkeys(names)))


def first_object(row: Column, names: list[str]) -> Column:
    """Of a struct's fields the first that is a JSON object."""
    return F.coalesce(*[F.when(row[n].startswith("{"), row[n]) for n in names])


def with_buckets(rows: DataFrame, v: Column, name: str = "b") -> DataFrame:
    """``rows`` with a struct (input, output, cache_read, cache_write) of the usage object ``v``; rows without tokens are left out.

    An object is parsed once for all the names that it may use.
    """
    one = rows.withColumn("_j", F.to_json(v))
    one = one.withColumn("_o", fields(F.col("_j"), [*NESTED[:-1], "metadata"])).withColumn("_m", fields(F.col("_o.metadata"), ["metrics"]))
    one = one.withColumn("_j", F.coalesce(first_object(F.col("_o"), NESTED[:-1]), first_object(F.col("_m"), ["metrics"]), F.col("_j")))
    one = one.withColumn("_u", fields(F.col("_j"), [*INPUT, *OUTPUT, *CACHE_READ, *CACHE_WRITE, *DETAILS]))
    one = one.withColumn("_d", fields(first_object(F.col("_u"), DETAILS), [*DETAIL_READ, *DETAIL_WRITE]))
    u, d = F.col("_u"), F.col("_d")
    sides = {
        "input": [u[n] for n in INPUT],
        "output": [u[n] for n in OUTPUT],
        "cache_read": [*[u[n] for n in CACHE_READ], *[d[n] for n in DETAIL_READ]],
        "cache_write": [*[u[n] for n in CACHE_WRITE], *[d[n] for n in DETAIL_WRITE]],
    }
    one = one.withColumn("_b", F.struct(*[text.num(F.coalesce(*c)).cast("long").alias(n) for n, c in sides.items()]))
    some = F.filter(F.array("_b"), lambda x: x["input"] + x["output"] + x["cache_read"] + x["cache_write"] > 0)
    return one.withColumn(name, F.explode(some)).drop("_j", "_o", "_m", "_u", "_d", "_b")


def _text_only(v: Column, name: str) -> Column:
    return F.when(kind_of(v, name) == "STRING", get(v, name))


def model_of(*objects: Column) -> Column:
    """The first model name in the objects, or in their messages, normalised."""
    names = F.array(*[_text_only(v, n) for v in objects for n in [*MODEL, "message.model"]])
    return F.get(F.filter(F.transform(F.filter(names, lambda x: x.isNotNull()), text.normalize_model), lambda x: x.isNotNull()), F.lit(0))


def time_of(*objects: Column, fallback: Column | None = None) -> Column:
    """The first time in the objects; else ``fallback``, such as the file's time."""
    said = [F.struct(get(v, n).alias("said"), (kind_of(v, n) == "STRING").alias("words")) for v in objects for n in TIME]
    said += [F.struct(_text_only(v, "time.created").alias("said"), F.lit(True).alias("words")) for v in objects]
    known = F.filter(F.array(*said), lambda x: x["said"].isNotNull() & F.coalesce(x["words"], F.lit(False)) | time.epoch(x["said"]).isNotNull())
    times = F.transform(known, lambda x: F.when(x["words"], time.instant(x["said"])).otherwise(time.epoch(x["said"])))
    first = F.get(F.filter(times, lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(first, fallback) if fallback is not None else first
