"""Reports: totals by group, cost shares, periods, source health and lists of recent rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import time
from ..functions.text import agent_label, model_key
from ..schema import cost, is_estimated, requests, second, token_sum
from .pricing import RATES, cost_parts, first_by, with_rates

MEASURES = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens"]
COSTS = ["estimated_cost", "input_cost", "cache_cost", "output_cost"]
#: Digits of summed costs: sums of doubles depend on their order beyond these; prices end before them, so halves don't occur.
DIGITS = 9


def group_key(by: str) -> Column:
    """agent, model, day or hour (UTC) of a row."""
    keys = {"agent": lambda: F.col("agent"), "model": lambda: model_key(F.col("model"), F.col("agent")), "day": lambda: time.utc_day(F.col("ts")), "hour": lambda: time.utc_hour(F.col("ts"))}
    if by not in keys:
        raise ValueError(f"group by {', '.join(keys)}, not {by}")
    return keys[by]()


def measures() -> list[Column]:
    return [
        *[F.sum(c).cast("long").alias(c) for c in MEASURES],
        F.round(F.sum(cost()), DIGITS).alias("estimated_cost"),
        *[F.round(F.sum(c), DIGITS).alias(c) for c in COSTS[1:]],
        F.sum(requests()).cast("long").alias("event_count"),
    ]


def with_parts(rows: DataFrame, bundled: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """``rows`` with input, cache and output cost: by rates, scaled to the recorded cost. Rows that still have the rates they were priced with use those."""
    parts = cost_parts(F.col("estimated_cost"))
    rated = rows if set(RATES) <= set(rows.columns) else with_rates(rows, bundled, custom)
    return rated.select(*[c for c in rows.columns if c not in RATES], *[parts[c].alias(c) for c in COSTS[1:]])


def in_period(rows: DataFrame, since: datetime | None = None, until: datetime | None = None, agent: str | None = None) -> DataFrame:
    """Rows with a time in [since, until], and of one agent if it is given."""
    out = rows.filter(F.col("ts").isNotNull())
    if since:
        out = out.filter(F.col("ts") >= time.moment(since))
    if until:
        out = out.filter(F.col("ts") <= time.moment(until))
    return out.filter(F.col("agent") == agent) if agent else out


def stats(rows: DataFrame, bundled: DataFrame, by: str = "agent", sort: str = "cost", custom: DataFrame | None = None) -> DataFrame:
    """Sums by group, greatest cost (or tokens) first."""
    out = with_parts(rows, bundled, custom).groupBy(group_key(by).alias("key")).agg(*measures())
    return out.orderBy(F.col("estimated_cost" if sort == "cost" else "total_tokens").desc(), "key")


def stats_with_total(rows: DataFrame, bundled: DataFrame, by: str = "agent") -> DataFrame:
    """As ``stats``, and a row with a null key for all of them: one pass by grouping sets."""
    keyed = with_parts(rows, bundled).withColumn("key", group_key(by))
    return keyed.rollup("key").agg(*measures(), F.grouping("key").cast("int").alias("is_total"))


def cost_report(rows: DataFrame, by: str = "agent") -> DataFrame:
    """Cost, tokens and share of cost by agent or model."""
    sums = rows.groupBy(group_key(by).alias(by)).agg(F.sum(cost()).alias("c"), F.sum("total_tokens").cast("long").alias("total_tokens"))
    total = sums.agg(F.sum("c").alias("t"))  # one row
    out = sums.join(F.broadcast(total), how="left")
    share = F.col("c") / F.when(F.coalesce("t", F.lit(0.0)) == 0, 1.0).otherwise(F.col("t"))
    return out.select(by, F.round("c", DIGITS).alias("estimated_cost"), "total_tokens", F.round(share, 9).alias("share")).orderBy(F.col("estimated_cost").desc(), by)


def top_models(rows: DataFrame, k: int = 15) -> DataFrame:
    return cost_report(rows, "model").drop("share").limit(k)


PERIODS = ["today", "24h", "7d", "30d", "all"]


def period_stats(rows: DataFrame, bundled: DataFrame, now: datetime, tz: str = "UTC") -> DataFrame:
    """(period, dim, key, sums) for each period, in all, by model and by agent.

    One scan sums each agent's models, for each period by a condition; what is
    spread over periods and grouping sets are those few sums, not rows.
    """
    starts = {p: time.since(None if p == "all" else p, now, tz) for p in PERIODS}
    held = [F.lit(True) if s is None else F.col("ts") >= time.moment(s) for s in starts.values()]
    told = {c: F.col(c) for c in MEASURES} | {"estimated_cost": cost()} | {c: F.col(c) for c in COSTS[1:]} | {"event_count": requests(), "rows": F.lit(1).cast("long")}
    keyed = with_parts(rows, bundled).filter("ts is not null").select(group_key("model").alias("m"), group_key("agent").alias("a"), "ts", *[c.alias(f"_{n}") for n, c in told.items()])
    sums = keyed.groupBy("m", "a").agg(*[F.sum(F.when(h, F.col(f"_{n}"))).alias(f"{n}_{i}") for i, h in enumerate(held) for n in told])
    each = F.array(*[F.struct(F.lit(p).alias("period"), *[F.col(f"{n}_{i}").alias(n) for n in told]) for i, p in enumerate(PERIODS)])
    spread = sums.select("m", "a", F.inline(each)).filter("rows > 0")
    last = [*[F.sum(c).cast("long").alias(c) for c in [*MEASURES, "event_count"]], *[F.round(F.sum(c), DIGITS).alias(c) for c in COSTS]]
    sets = spread.groupingSets([["period"], ["period", "m"], ["period", "a"]], "period", "m", "a").agg(*last, F.grouping("m").alias("gm"), F.grouping("a").alias("ga"))
    dim = F.when(F.col("gm") == 0, "model").when(F.col("ga") == 0, "agent").otherwise("total")
    return sets.select("period", dim.alias("dim"), F.coalesce("m", "a").alias("key"), *MEASURES, *COSTS, "event_count")


def period_documents(stats: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(period, total, by_model, by_agent): the sums of ``period_stats`` as JSON, lists sorted by key, for an export that has one document a period."""
    row = F.struct(*(columns or [c for c in stats.columns if c not in ("period", "dim")]))
    listed = lambda dim: F.to_json(F.array_sort(F.collect_list(F.when(F.col("dim") == dim, row))))
    return stats.groupBy("period").agg(F.to_json(F.first(F.when(F.col("dim") == "total", row), True)).alias("total"), listed("model").alias("by_model"), listed("agent").alias("by_agent"))


def agent_status(rows: DataFrame, agents: DataFrame) -> DataFrame:
    """``agents`` (agent) with label, number of rows and last time; agents without rows too."""
    seen = rows.groupBy("agent").agg(F.count(F.lit(1)).alias("event_count"), F.max(second()).alias("last_event"))
    out = agents.join(seen, "agent", "left")
    return out.select("agent", agent_label(F.col("agent")).alias("label"), F.coalesce("event_count", F.lit(0)).alias("event_count"), "last_event")


def top_agents(rows: DataFrame, agents: DataFrame, k: int = 6) -> DataFrame:
    return agent_status(rows, agents).orderBy(F.col("event_count").desc(), "agent").limit(k)


def recent(rows: DataFrame, limit: int = 100, agent: str | None = None) -> DataFrame:
    """The newest rows, 1 to 1000 of them."""
    picked = rows.filter(F.col("agent") == agent) if agent else rows
    return picked.filter("ts is not null").orderBy(F.col("ts").desc(), "id").limit(min(1000, max(1, limit)))


def is_live(total: Column | None = None) -> Column:
    """Whether a row is a single call rather than a rollup."""
    count = F.coalesce(F.col("request_count"), F.lit(0))
    size = F.coalesce(F.nullif(F.col("total_tokens"), F.lit(0)), token_sum()) if total is None else total
    guess = (count <= 1) & (size <= 2_000_000) & ((size > 0) | (cost() > 0))
    return F.col("ts").isNotNull() & (count <= 5) & (~is_estimated() | guess)


def recent_live(cached: DataFrame, hot: DataFrame, limit: int = 50, since: datetime | None = None, until: datetime | None = None, agent: str | None = None) -> DataFrame:
    """The newest live calls of both; of calls that agree in agent, second, model, input and output the last cached one, else the first hot one."""
    tagged = in_period(cached, since, until, agent).withColumn("is_hot", F.lit(0)).unionByName(in_period(hot, since, until, agent).withColumn("is_hot", F.lit(1)))
    live = tagged.filter(is_live()).withColumns({"_s": second(), "_m": F.coalesce("model", F.lit(""))})
    order = F.when(F.col("is_hot") == 0, -F.col("seq")).otherwise(F.col("seq"))
    kept = first_by(live, ["agent", "_s", "_m", "input_tokens", "output_tokens"], [F.col("is_hot"), order])
    return kept.drop("_s", "_m", "is_hot").orderBy(F.col("ts").desc(), "id").limit(min(1000, max(1, limit)))


def sanitize(rows: DataFrame) -> DataFrame:
    """Rows fit for use: with an id and an agent, numbers for numbers, whole positive counts, known defaults."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = rows.filter((F.coalesce("id", F.lit("")) != "") & (F.coalesce("agent", F.lit("")) != ""))
    out = out.withColumns({c: n(c) for c in MEASURES[:4]})
    return out.withColumns(
        {
            "total_tokens": F.coalesce(F.nullif(F.col("total_tokens"), F.lit(0)), token_sum()).cast("long"),
            "estimated_cost": F.when(~F.isnan("estimated_cost"), F.col("estimated_cost")),
            "currency": F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD")),
            "pricing_status": F.when(F.col("pricing_status").isin("priced", "unknown_model", "zero_rate", "estimated"), F.col("pricing_status")).otherwise("estimated"),
            "estimated": is_estimated(),
            "request_count": F.when(F.col("request_count") > 0, F.floor("request_count")).cast("long"),
        }
    )
