"""Bundles of small files under a limit for each and one for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of a bundle of mirrored files, and names of day aggregates that belong into it.
MOST_FILE, MOST_TOTAL = 2 * 1024 * 1024, 8 * 1024 * 1024
ALLOWED = ["usage-daily.json", "usagedaily.json", "dailysummary.json", "db.json", "usage.json", "usagedata.json", "config.json", "ok.json"]


def belongs(path: Column) -> Column:
    """Whether a file may be bundled: a day aggregate or another small JSON document, but no history of requests."""
    base = F.lower(F.substring_index(path, "/", -1))
    requests = base.endswith(".jsonl") | base.contains("usage-history") | base.contains("usagehistory") | base.contains("request-detail") | base.contains("requestdetail")
    return ~requests & (base.isin(ALLOWED) | (base.endswith(".json") & ~base.contains("history")))


def bundle(files: DataFrame, keys: list[str], path: str = "path", size: str = "size", most_file: int = MOST_FILE, most_total: int = MOST_TOTAL) -> DataFrame:
    """(keys, path, size, place, reason) of all files: those that go into their key's bundle have a ``place`` (from 1), others a ``reason``.

    Files are tried in order of path; one that would go over the total is left
    out, and a later, smaller one may still fit. So the sum isn't a running sum of all
    but of those taken, which a fold along one key's files carries. What is
    gathered for a key is paths and sizes of files that could be taken, not texts.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    told = files.select(*keys, F.col(path).alias("path"), n.alias("size"), F.when(~belongs(F.col(path)), "request-level or disallowed").when(n > most_file, "over file cap").alias("reason"))
    free = told.filter("reason is null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("path", "size"))).alias("fs"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<string>").alias("taken"))

    def step(state: Column, f: Column) -> Column:
        fits = state["sum"] + f["size"] <= most_total
        return F.when(fits, F.struct((state["sum"] + f["size"]).alias("sum"), F.array_append(state["taken"], f["path"]).alias("taken"))).otherwise(state)

    names = {k: f"_{k}" for k in keys}
    taken = free.select(*[F.col(k).alias(n) for k, n in names.items()], F.posexplode(F.aggregate("fs", start, step)["taken"]).alias("at", "_path"))
    own = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    met = told.join(taken, [*own, F.col("path") == F.col("_path")], "left")
    return met.select(*keys, "path", "size", (F.col("at") + 1).alias("place"), F.when(F.col("at").isNull(), F.coalesce("reason", F.lit("over total cap"))).alias("reason"))
