"""Deduplication of usage rows: by id, by content, by file, and of stale or mixed rollups.

Where one of several rows is kept, ``max_by`` over a struct of what makes a row
richer does it, with partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import cost, has_model, is_estimated, is_router, second, weight
from .pricing import first_by


def richness() -> Column:
    """Real before estimated, more tokens, a model, higher cost; then the earlier row."""
    return F.struct((~is_estimated()).alias("real"), weight().alias("w"), has_model().alias("m"), cost().alias("c"), (-F.col("seq")).alias("s"))


def richest(rows: DataFrame, *keys: Column, order: Column | None = None) -> DataFrame:
    """One row for each key: the richest."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return rows.groupBy(*named).agg(F.max_by(whole, richness() if order is None else order).alias("_r")).select("_r.*")


def union_first(*parts: DataFrame) -> DataFrame:
    """Rows by id; of equal ids the one of the first part, then the earliest."""
    rows = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return first_by(out.filter(F.coalesce("id", F.lit("")) != ""), ["id"], [F.col("_part"), F.col("seq")]).drop("_part")


def _renumbered(parts: tuple[DataFrame, ...]) -> DataFrame:
    """All parts; rows of earlier parts come first among equals."""
    out = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_part", F.lit(i)))
    return out


def richer_union(*parts: DataFrame) -> DataFrame:
    """Rows by id; of equal ids the richest."""
    rows = _renumbered(parts).filter(F.coalesce("id", F.lit("")) != "")
    order = F.struct((~is_estimated()).alias("real"), weight().alias("w"), has_model().alias("m"), cost().alias("c"), (-F.col("_part")).alias("p"), (-F.col("seq")).alias("s"))
    return richest(rows, F.col("id"), order=order).drop("_part")


def collapse_exact(rows: DataFrame) -> DataFrame:
    """One row of clones that differ in id only; router rows are clones if they agree in second, model, input, output and workspace."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    router = is_router(F.col("agent"))
    only = lambda c: F.when(router, F.lit("")).otherwise(c)
    stamp = F.coalesce(F.when(router, second()).otherwise(F.col("ts").cast("string")), F.lit(""))
    where = F.when(router, text("workspace")).otherwise(text("source_path"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return richest(rows, F.col("agent"), stamp, text("model"), n("input_tokens"), n("output_tokens"), only(text("cache_read_tokens")), only(text("cache_write_tokens")), where)


def path(c: Column | None = None) -> Column:
    return F.lower(F.replace(F.col("source_path") if c is None else c, F.lit("\\"), F.lit("/")))


def own_key() -> Column:
    """A key of the row alone, for rows that are to meet none in a join: nulls would all go to one task."""
    return F.concat(F.lit("id:"), F.coalesce("id", F.col("seq").cast("string"), F.lit("")))


def drop_stale_residuals(rows: DataFrame) -> DataFrame:
    """Without grok's stale stream residuals (estimated, no output): all of them where their file has better rows, else all but its heaviest.

    Other rows meet no file; they join by their id, so that they spread over tasks.
    """
    of_file = (F.col("agent") == "grok") & path().endswith("updates.jsonl")
    ghost = is_estimated() & (F.coalesce("output_tokens", F.lit(0)) <= 0)
    files = rows.filter(of_file).groupBy(path().alias("_path"))
    best = files.agg(F.max(~ghost).alias("_better"), F.max(F.when(ghost, F.struct(weight().alias("w"), (-F.col("seq")).alias("s"), F.col("id").alias("id")))).alias("_best"))
    marked = rows.withColumn("_ghost", F.coalesce(of_file & ghost, F.lit(False)))
    out = marked.withColumn("_path", F.when(F.col("_ghost"), path()).otherwise(own_key())).join(best, "_path", "left")
    keep = ~F.col("_ghost") | (~F.col("_better") & (F.col("id") == F.col("_best.id")))
    return out.filter(keep).select(rows.columns)


def collapse_source_path(rows: DataFrame) -> DataFrame:
    """One row for each windsurf session file, the richest; then no stale residuals."""
    one = F.coalesce((F.col("agent") == "windsurf") & path().endswith(".pb"), F.lit(False))
    return drop_stale_residuals(rows.filter(~one).unionByName(richest(rows.filter(one), path())))


def is_mixed() -> Column:
    return F.coalesce(F.trim("model"), F.lit("")).isin("", "mixed", "unknown")


def dedupe_mixed(rollups: DataFrame, keys: list[str]) -> DataFrame:
    """Day rollups (by ``keys``) without the mixed ones that rollups of models explain: 95 % of its tokens, or of its cost and 90 % of its tokens."""
    named = ~is_mixed()
    sums = rollups.groupBy(*keys).agg(F.sum(F.when(named, weight()).otherwise(0)).alias("_tok"), F.sum(F.when(named, cost()).otherwise(0.0)).alias("_cost"), F.max(named).alias("_any"))
    out = rollups.join(sums, keys)
    told = ((weight() > 0) & (F.col("_tok") >= weight() * 0.95)) | ((cost() > 0) & (F.col("_cost") >= cost() * 0.95) & (F.col("_tok") >= weight() * 0.9))
    return out.filter(named | ~F.col("_any") | ~told).select(rollups.columns)


def router_twins(rows: DataFrame) -> DataFrame:
    """Request rows as read: the first of an id, then of twins (agent, second, model, input, output, workspace) the one with most tokens, then cost; the first of equals."""
    once = first_by(rows, ["id"], [F.col("seq")])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    size = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)) + F.coalesce("cache_read_tokens", F.lit(0)) + F.coalesce("cache_write_tokens", F.lit(0))
    order = F.struct(size.alias("w"), cost().alias("c"), (-F.col("seq")).alias("s"))
    return richest(once, F.col("agent"), F.coalesce(second(), F.lit("")), text("model"), F.col("input_tokens"), F.col("output_tokens"), text("workspace"), order=order)


def twin_pick(rows: DataFrame, key: str, outgoing: Column) -> DataFrame:
    """One row of a request's two records: the outgoing one, else the one with more tokens, else the costlier; the first of equals."""
    order = F.struct(outgoing.alias("o"), weight().alias("w"), cost().alias("c"), (-F.col("seq")).alias("s"))
    return richest(rows, F.col(key), order=order)


def best_day(days: DataFrame, keys: list[str], score: list[str], last: bool = False) -> DataFrame:
    """Of several versions of a day the one with the greatest scores in order; of equals the first, or the last."""
    seq = F.col("seq") if last else -F.col("seq")
    whole = F.struct(*[F.col(c) for c in days.columns])
    return days.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(whole, F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in score], seq.alias("s"))).alias("_r")).select("_r.*")


def running_window(keys: list[str], *order: str) -> W:
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
