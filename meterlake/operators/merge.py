"""Merging scans, snapshots and other machines' rollups. Usage only grows: a thinner rescan never replaces a richer day."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import time
from ..functions.text import normalize_agent, normalize_model, sanitize_machine, stable_id
from ..schema import ROUTERS, conform, cost, day, is_estimated, requests, weight
from ..tables import cut
from .dedup import collapse_exact, collapse_source_path, drop_stale_residuals, own_key, path, richer_union
from .router_days import collapse_router_days

HOUR_PATH, DAY_PATH, ANY_PATH = "backup:gist-hour", "backup:gist-daily", "backup:gist"
#: Rollups keep hours for this long before now, days before that.
HOURS_KEPT = timedelta(days=8)


def heal(rows: DataFrame) -> DataFrame:
    """Router days, session files and clones collapsed. Rows are read several times, so each step starts from a written table."""
    return collapse_exact(collapse_source_path(cut(collapse_router_days(cut(rows)))))


def merge_richer(*parts: DataFrame) -> DataFrame:
    return heal(richer_union(*parts))


def _side_sums(rows: DataFrame, tag: str) -> DataFrame:
    ghost = F.coalesce((F.col("agent") == "grok") & is_estimated() & (F.coalesce("output_tokens", F.lit(0)) == 0) & path().endswith("updates.jsonl"), F.lit(False))
    sums = {
        "live": F.count(F.when(~is_estimated(), 1)),
        "guess": F.count(F.when(is_estimated() & (F.col("output_tokens") > 0), 1)),
        "tok": F.sum(F.when(ghost, 0).otherwise(weight())),
        "cost": F.sum(cost()),
        "req": F.sum(requests()),
        "rows": F.count(F.lit(1)),
    }
    return rows.groupBy("agent", "_bucket").agg(*[c.alias(f"{tag}_{n}") for n, c in sums.items()])


def keeps_old() -> Column:
    """Whether the old side of an agent's day stays: more real rows, more estimates with output, more tokens, cost, requests, rows; the old one of equals."""
    out = F.when(F.col("n_rows").isNull(), True).when(F.col("p_rows").isNull(), False)
    for c in ("live", "guess"):
        out = out.when(F.col(f"p_{c}") != F.col(f"n_{c}"), F.col(f"p_{c}") > F.col(f"n_{c}"))
    for c in ("tok", "cost"):
        out = out.when(F.col(f"p_{c}") > F.col(f"n_{c}") * 1.001, True).when(F.col(f"n_{c}") > F.col(f"p_{c}") * 1.001, False)
    return out.when(F.col("p_req") != F.col("n_req"), F.col("p_req") > F.col("n_req")).otherwise(F.col("p_rows") >= F.col("n_rows"))


def monotonic_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each agent and UTC day all rows of the old or of the new side, whichever is richer. Rows without a day are days of their own.

    Only the choice, one row an agent's day, is written; both sides are read twice.
    """
    bucket = F.coalesce(day(), F.concat(F.lit("id:"), "id"))
    sides = [drop_stale_residuals(s).withColumn("agent", normalize_agent(F.col("agent"))).withColumn("_bucket", bucket) for s in (old, new)]
    keys = ["agent", "_bucket"]
    choice = cut(_side_sums(sides[0], "p").join(_side_sums(sides[1], "n"), keys, "full_outer").select(*keys, keeps_old().alias("_old")))
    kept = [s.join(choice.filter(F.col("_old") == keep), keys, "left_semi") for s, keep in zip(sides, (True, False), strict=True)]
    return drop_stale_residuals(kept[0].unionByName(kept[1]).drop("_bucket"))


# --- rollups of several machines ----------------------------------------------------------------------


def is_rollup() -> Column:
    return F.coalesce(F.col("source_path").startswith(ANY_PATH), F.lit(False))


def machine_of() -> Column:
    """The machine of a rollup row: from its path, else from its workspace; null for other rows and unnamed machines."""
    tail = F.regexp_extract("source_path", r"^backup:gist-(?:hour|daily):(.*)$", 1)
    name = F.coalesce(F.nullif(F.trim(tail), F.lit("")), F.when(is_rollup(), F.nullif(F.trim("workspace"), F.lit(""))))
    return F.when(name.isNotNull(), sanitize_machine(name))


def machines(rows: DataFrame) -> DataFrame:
    return rows.select(machine_of().alias("machine")).filter("machine is not null").distinct().orderBy("machine")


def tiered_rollup(rows: DataFrame, now: datetime, machine: str) -> DataFrame:
    """Rollups of a machine's rows by agent and model: by hour for the last 8 days, by day before. Each is stamped with its last row's time."""
    cut = time.moment(now - HOURS_KEPT)
    own = rows.filter(F.col("agent").isNotNull() & F.col("ts").isNotNull() & ~is_rollup())
    hourly = F.col("ts") >= cut
    bucket = F.when(hourly, F.date_format("ts", "yyyy-MM-dd'T'HH")).otherwise(day())
    name = sanitize_machine(F.lit(machine))
    measures = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens", "estimated_cost"]
    sums = lambda grouped: grouped.agg(*[F.sum(c).alias(c) for c in measures], F.max("ts").alias("ts"))
    # summed by names as written, which are few, then by normal names
    raw = sums(own.withColumn("estimated_cost", cost()).groupBy(hourly.alias("hourly"), bucket.alias("bucket"), "agent", "model"))
    out = sums(raw.groupBy("hourly", "bucket", "agent", F.lower(normalize_model(F.col("model"))).alias("model")))
    kind = F.when(F.col("hourly"), "gist-hour").otherwise("gist-daily")
    out = out.withColumns(
        {
            "id": stable_id(kind, name, F.col("bucket"), F.col("agent"), F.coalesce("model", F.lit("unknown"))),
            "currency": F.lit("USD"),
            "pricing_status": F.lit("estimated"),
            "workspace": name,
            "source_path": F.concat(F.when(F.col("hourly"), HOUR_PATH).otherwise(DAY_PATH), F.lit(":"), name),
            "estimated": F.lit(True),
        }
    )
    return conform(out)


def coverage_key() -> list[Column]:
    return [F.coalesce(day(), F.lit("")).alias("_d"), F.col("agent"), F.coalesce(F.lower(normalize_model(F.col("model"))), F.lit("")).alias("_m")]


def uncovered(local: DataFrame, imported: DataFrame, machine: str) -> DataFrame:
    """Imported rows without this machine's rollups of days, agents and models that local rows cover."""
    own = sanitize_machine(F.lit(machine))
    mine = is_rollup() & (F.coalesce(machine_of(), own) == own)
    covered = local.filter(F.col("agent").isNotNull() & ~is_rollup()).select(*coverage_key()).distinct().withColumn("_mine", F.lit(True))
    keyed = imported.filter(F.col("agent").isNotNull()).withColumns({"_mine": mine, "_d": coverage_key()[0], "_m": coverage_key()[2]})
    return keyed.join(covered, ["_mine", "_d", "agent", "_m"], "left_anti").select(imported.columns)


def merge_local_over_rollups(local: DataFrame, imported: DataFrame, machine: str) -> DataFrame:
    return merge_richer(local, uncovered(local, imported, machine))


def merge_machines(local_rollups: DataFrame, remote: DataFrame, machine: str) -> DataFrame:
    """Other machines' rollups and whole rows of the remote side, and this machine's local rollups."""
    own = sanitize_machine(F.lit(machine))
    others = remote.filter(F.col("agent").isNotNull() & ~(is_rollup() & F.coalesce(machine_of() == own, F.lit(False))))
    return merge_richer(others, local_rollups)


def light_merge(old: DataFrame, fresh: DataFrame, least: int = 5) -> DataFrame:
    """A light scan over what was known: agents without fresh rows keep theirs, routers with several are replaced, others merge by id."""
    found = fresh.groupBy("agent").agg(F.count(F.lit(1)).alias("_n"))
    replaced = found.filter(F.col("agent").isin([*ROUTERS, "antigravity"]) & (F.col("_n") >= least)).select("agent")
    seen = fresh.filter((F.col("agent") == "grok") & path().endswith("updates.jsonl")).select(path().alias("_path"), F.lit(True).alias("_ghost")).distinct()
    ghost = F.coalesce((F.col("agent") == "grok") & is_estimated() & (F.coalesce("output_tokens", F.lit(0)) <= 0), F.lit(False))
    kept = old.join(F.broadcast(replaced), "agent", "left_anti")  # agents are a closed set
    kept = kept.withColumns({"_ghost": ghost, "_path": F.when(ghost, path()).otherwise(own_key())}).join(seen, ["_path", "_ghost"], "left_anti").select(old.columns)
    return richer_union(kept, fresh)


def finalize(scanned: DataFrame, old: DataFrame, imported: DataFrame | None, machine: str) -> DataFrame:
    """All merges in order: heal the scan, keep richer old days, add imported rows, keep richer old days again."""
    rows = heal(monotonic_merge(old, cut(heal(richer_union(scanned)))))
    if imported is not None:
        rows = cut(merge_local_over_rollups(cut(rows), imported, machine))
        rows = heal(monotonic_merge(old, rows))
    return rows
