"""Request routers: request rows, day documents in their several shapes, and both reconciled."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, time
from ..functions.usage import DETAIL_READ, DETAIL_WRITE, DETAILS, fields, first_object, first_of, get, is_object, obj
from ..operators.dedup import router_twins
from ..operators.router_days import reconcile_days
from ..schema import conform
from . import files, sqlite

# Names of fields and files, in order of trial.
TOKENS_IN = ["prompt_tokens", "promptTokens", "input_tokens", "inputTokens"]
TOKENS_OUT = ["completion_tokens", "completionTokens", "output_tokens", "outputTokens"]
TOKENS_READ = ["cached_tokens", "cache_read_tokens", "cache_read_input_tokens", "cacheReadTokens", "cachedReadTokens", "cached_content_token_count"]
TOKENS_WRITE = ["cache_write_tokens", "cache_creation_input_tokens", "cacheWriteTokens", "cache_creation_tokens"]
ROW_IN = ["promptTokens", "prompt_tokens", "inputTokens", "input_tokens"]
ROW_OUT = ["completionTokens", "completion_tokens", "outputTokens", "output_tokens"]
ROW_READ = ["cachedTokens", "cached_tokens", "cacheReadTokens", "cache_read_input_tokens", "cache_read_tokens"]
ROW_WRITE = ["cacheWriteTokens", "cache_write_tokens", "cache_creation_input_tokens"]
ROW_TIME = ["timestamp", "createdAt", "created_at", "date", "ts"]
ROW_COST = ["cost", "estimatedCost", "usd"]
ROW_REQUESTS = ["requests", "requestCount", "request_count"]
HISTORY = ["history", "records", "events", "usageHistory"]
DAILY = ["dailySummary", "daily", "usageDaily", "usageData.dailySummary", "usage.dailySummary"]
HISTORY_FILES = r"(?:.*/)?(?:usage-history|request-details|history)\.jsonl$"
DAILY_FILES = r"(?:.*/)?(?:usage|usageData|usage-daily|daily|db)\.json$"
#: Roots in whose names these parts stand come first: of twins the first is kept.
PREFERRED = [("mirror", 100), ("vps", 80), ("backup", 20)]


def by_priority(roots: list[str]) -> list[str]:
    """Roots, copies of remote ones first; otherwise as given."""
    return sorted(roots, key=lambda r: -next((p for part, p in PREFERRED if part in r.lower()), 10))


def request_rows(rows: DataFrame, agent: str, free: bool = False) -> DataFrame:
    """(path, line_no, row) -> usage rows with native_id and router_cost. Rows without tokens and cost, and rows without a time, are left out.

    A cost is one above 0; with ``free`` every cost that a row states is one, also 0.
    The id leaves out the path, so that copies of a row in two places are one.
    """
    names = ["tokens", *ROW_IN, *ROW_OUT, *ROW_READ, *ROW_WRITE, *ROW_TIME, *ROW_COST, *ROW_REQUESTS, "meta", "model", "rawModel", "provider", "endpoint", "id", "connectionId"]
    one = rows.withColumn("_r", fields(F.to_json("row"), names))
    r = F.col("_r")
    one = one.withColumn("_t", fields(r["tokens"], [*TOKENS_IN, *TOKENS_OUT, *TOKENS_READ, *TOKENS_WRITE, *DETAILS])).withColumn("_m", fields(r["meta"], ROW_COST[:2]))
    t, m = F.col("_t"), F.col("_m")
    one = one.withColumn("_d", fields(first_object(t, DETAILS), [*DETAIL_READ, *DETAIL_WRITE]))
    d = F.col("_d")
    n = lambda *cols: text.num(F.coalesce(*cols))
    of = lambda v, which: [v[x] for x in which]
    name = lambda f: F.nullif(r[f], F.lit(""))
    stated = F.coalesce(*of(r, ROW_TIME))
    paid = lambda value, *said: F.when(F.coalesce(*said).isNotNull() if free else value > 0, value)
    hint, cost = of(r, ROW_COST), [*of(r, ROW_COST), *of(m, ROW_COST[:2])]
    out = one.select(
        F.col("line_no").alias("seq"), "path",
        n(*of(t, TOKENS_IN), *of(r, ROW_IN)).cast("long").alias("input_tokens"),
        n(*of(t, TOKENS_OUT), *of(r, ROW_OUT)).cast("long").alias("output_tokens"),
        n(*of(t, TOKENS_READ), *of(d, DETAIL_READ), *of(r, ROW_READ)).cast("long").alias("cache_read_tokens"),
        n(*of(t, TOKENS_WRITE), *of(d, DETAIL_WRITE), *of(r, ROW_WRITE)).cast("long").alias("cache_write_tokens"),
        paid(n(*hint), *hint).alias("hint"), n(*of(r, ROW_REQUESTS)).alias("asked"), paid(n(*cost), *cost).alias("cost"),
        F.coalesce(name("model"), name("rawModel")).alias("said"), F.coalesce(time.instant(stated), time.epoch(stated)).alias("ts"), name("provider").alias("provider"), name("endpoint").alias("endpoint"),
        F.coalesce(r["id"], F.concat_ws("-", F.lit("row"), "line_no")).alias("native_id"), F.coalesce(name("connectionId"), F.lit("")).alias("connection"),
    )
    total = lambda x: x["input_tokens"] + x["output_tokens"] + x["cache_read_tokens"] + x["cache_write_tokens"]
    used = F.filter(F.array(F.struct(*out.columns)), lambda x: x["ts"].isNotNull() & ((total(x) > 0) | (x["hint"].isNotNull() & (x["asked"] > 0))))
    out = out.select(F.explode(used).alias("x")).select("x.*").withColumns({"model": text.normalize_model(F.col("said")), "n": F.expr("input_tokens + output_tokens + cache_read_tokens + cache_write_tokens")})
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return out.select(
        "seq", text.stable_id(F.lit(agent), F.col("native_id"), F.col("input_tokens"), F.col("output_tokens"), stamp, F.col("connection"), F.col("model")).alias("id"), F.lit(agent).alias("agent"), "model", "ts",
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", F.col("n").alias("total_tokens"), F.coalesce(F.concat(F.lit("provider:"), "provider"), "endpoint").alias("workspace"),
        F.col("path").alias("source_path"), F.lit(False).alias("estimated"), F.greatest(F.lit(1), F.floor("asked")).cast("long").alias("request_count"), F.col("cost").alias("router_cost"), "native_id",
    )


def history_rows(documents: DataFrame) -> DataFrame:
    """(path, mtime, line_no, row) of the history arrays in documents, also below usageData or usage."""
    doc = documents.withColumn("doc", F.try_parse_json("value")).filter("doc is not null")
    paths = [f"${p}.{h}" for p in ("", ".usageData", ".usage") for h in HISTORY]
    rows = F.coalesce(F.try_variant_get("doc", "$", "array<variant>"), *[F.try_variant_get("doc", p, "array<variant>") for p in paths])
    return doc.select("path", "mtime", F.posexplode(rows).alias("at", "row")).select("path", "mtime", (F.col("at") + 1).cast("long").alias("line_no"), "row")


def day_maps(documents: DataFrame) -> DataFrame:
    """(path, seq, day, data): days of documents that are a map, hold one, or are a list of {dateKey, data}."""
    doc = documents.withColumn("doc", F.try_parse_json("value")).filter("doc is not null")
    inner = F.coalesce(*[obj(F.col("doc"), p) for p in DAILY], F.when(is_object(F.col("doc")), F.col("doc")))
    as_map = F.try_variant_get(inner, "$", "map<string, variant>")
    mapped = doc.select("path", F.explode(as_map).alias("day", "data"))
    listed = doc.select("path", F.explode(F.try_variant_get("doc", "$", "array<variant>")).alias("x"))
    data = F.coalesce(obj(F.col("x"), "data"), F.try_parse_json(get(F.col("x"), "data")), F.col("x"))
    return mapped.unionByName(listed.select("path", get(F.col("x"), "dateKey").alias("day"), data.alias("data"))).filter(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$") & is_object(F.col("data")))


def day_documents(days: DataFrame, agent: str, seq: Column) -> DataFrame:
    """(path, day, data) -> day documents with numbers and a map of models."""
    z = lambda v, names: text.num(F.coalesce(*first_of(v, names)))
    cache = ["cachedTokens", "cached_tokens", "cacheReadTokens", "cache_read_input_tokens"]
    fields = lambda v, wide: {
        "requests": z(v, ["requests"]),
        "input": z(v, ["promptTokens", "prompt_tokens", *(["inputTokens"] if wide else [])]),
        "output": z(v, ["completionTokens", "completion_tokens", *(["outputTokens"] if wide else [])]),
        "cache": z(v, cache if wide else cache[:3]),
        "cost": z(v, ["cost"]),
    }
    models = F.map_filter(F.try_variant_get("data", "$.byModel", "map<string, variant>"), lambda _, m: is_object(m))
    entry = lambda m: F.struct(*[c.alias(n) for n, c in fields(m, True).items()], get(m, "rawModel").alias("raw_model"), get(m, "provider").alias("provider"))
    return days.select(seq.cast("long").alias("seq"), F.lit(agent).alias("agent"), "day", *[c.alias(n) for n, c in fields(F.col("data"), False).items()], F.transform_values(models, lambda _, m: entry(m)).alias("models"), F.col("path").alias("source"))


def read_router(spark: SparkSession, roots: list[str], agent: str, now: datetime | None = None) -> DataFrame:
    """Usage rows of a router's folders: request histories (JSON lines, documents, databases) reconciled with day documents; unpriced, with router_cost."""
    roots = by_priority(roots)
    order = F.lit(0)
    for i, r in enumerate(roots):
        order = F.when(F.col("path").contains(r.rstrip("/")), i).otherwise(order)
    lines = files.read_json_lines(spark, roots, HISTORY_FILES).select("path", "mtime", "line_no", "row")
    documents = files.read_documents(spark, roots, DAILY_FILES)
    tables = sqlite.read_tables(spark, roots, ["usageHistory", "usageDaily"])
    stored = tables.filter("name = 'usageHistory'").select("path", "mtime", "line_no", F.parse_json("data").alias("row"))
    requests = request_rows(lines.unionByName(history_rows(documents)).unionByName(stored), agent)
    ranked = requests.withColumn("path", F.col("source_path")).withColumn("seq", order.cast("long") * F.lit(1 << 40) + F.col("seq")).drop("path")
    calls = router_twins(ranked.withColumn("estimated_cost", F.col("router_cost")))
    kept = tables.filter("name = 'usageDaily'").select("path", get(F.parse_json("data"), "dateKey").alias("day"), F.try_parse_json(get(F.parse_json("data"), "data")).alias("data")).filter("data is not null")
    days = day_documents(day_maps(documents).unionByName(kept), agent, order)
    moment = time.moment(now or datetime.now(timezone.utc))
    out = reconcile_days(conform(calls), days, moment)
    return out.withColumn("router_cost", F.col("estimated_cost"))
