"""Pricing: which rate a model takes, what a row costs, and how the cost splits.

Names are resolved once for each distinct model and joined back. Names repeat
in logs, so these are few; still, Spark chooses the join from their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rates as R
from ..functions.text import normalize_model, strip
from ..schema import TOKENS, is_estimated, token_sum

RATES = ["input_rate", "output_rate", "cache_read_rate", "cache_write_rate", "long_context"]


def raw_name(model: Column) -> Column:
    return F.lower(strip(F.coalesce(normalize_model(model), model)))


def _family(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for parts, key in reversed(R.FAMILIES):
        out = F.when(reduce(lambda a, b: a & b, [raw.contains(p) for p in parts]), key).otherwise(out)
    return out


#: Rates' names of fewer characters aren't looked for within names.
WITHIN = 5


def resolve_models(models: DataFrame, bundled: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """``models`` (model) with raw and key: a custom rate, another name, a rate's own name, the longest rate name (5 or more) within it, its family, or null."""
    aliases = F.create_map(*[F.lit(x) for kv in R.ALIASES.items() for x in kv])
    named = models.select("model").distinct().withColumn("raw", F.nullif(raw_name(F.col("model")), F.lit("")))
    keys = bundled.select("key", (F.col("ord") + F.lit(1_000_000)).alias("ord"), F.lit(False).alias("own"))
    if custom is not None:
        keys = custom.select("key", "ord", F.lit(True).alias("own")).unionByName(keys)
    exact = keys.groupBy(F.col("key").alias("raw")).agg(F.max("own").alias("own"))
    # a rate's first characters meet every stretch of that length in a name; the whole is compared then
    dashed = F.replace(F.col("raw"), F.lit("_"), F.lit("-"))
    stretches = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - WITHIN + 1)), lambda i: c.substr(i, F.lit(WITHIN)))
    asked = named.withColumn("start", F.explode(F.array_distinct(F.concat(stretches(F.col("raw")), stretches(dashed)))))
    starts = keys.filter((F.length("key") >= WITHIN) & (F.col("key") != "default")).withColumn("start", F.substring("key", 1, WITHIN))
    inside = F.col("raw").contains(F.col("key")) | dashed.contains(F.col("key"))
    longest = asked.join(starts, "start").filter(inside).groupBy("model").agg(F.max_by("key", F.struct(F.length("key"), -F.col("ord"))).alias("part"))
    out = named.join(exact, "raw", "left").join(longest, "model", "left")
    alias = F.try_element_at(aliases, F.col("raw"))
    key = F.when(F.col("own"), F.col("raw")).otherwise(F.coalesce(alias, F.when(F.col("own").isNotNull(), F.col("raw")), F.col("part"), _family(F.col("raw"))))
    return out.select("model", "raw", key.alias("key"))


def model_rates(models: DataFrame, bundled: DataFrame, custom: DataFrame | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """(model, key, source, rates): custom rates first, then the catalog's, then bundled ones, else the default's."""
    known = resolve_models(models, bundled, custom)
    full = F.lower(strip(F.col("model")))
    tiers: list[tuple[str, DataFrame]] = []
    if custom is not None:
        for name, by in (("custom_raw", "raw"), ("custom_full", "full"), ("custom_key", "lowkey")):
            tiers.append(("custom", custom.select(F.col("key").alias(by), F.struct(F.col("key").alias("key"), *RATES).alias(name))))
    if catalog is not None:
        from .catalog import lookup_catalog

        tiers.append(("catalog", lookup_catalog(models, catalog).select("model", F.struct(F.col("id").alias("key"), *RATES).alias("catalog_rate"))))
    tiers.append(("bundled", bundled.select(F.col("key").alias("lookup"), F.struct(F.col("key").alias("key"), *RATES).alias("bundled_rate"))))
    out = known.withColumns({"full": full, "lowkey": F.lower("key"), "lookup": F.col("key")})
    found, source = [], F.lit("default")
    for label, tier in tiers:
        by, name = tier.columns
        key = out[by].eqNullSafe(tier[by])
        out = out.join(tier, key, "left").select(*[out[c] for c in out.columns], tier[name])
        found.append((label, name))
    for label, name in reversed(found):
        source = F.when(F.col(name).isNotNull(), label).otherwise(source)
    default = bundled.filter("key = 'default'").select(F.struct(F.col("key").alias("key"), *RATES).alias("default_rate"))
    out = out.join(F.broadcast(default), how="left").withColumn("rate", F.coalesce(*[F.col(n) for _, n in found], "default_rate"))
    shown = F.when(source == "default", F.coalesce("key", F.lit("default"))).when(source == "bundled", F.col("key")).otherwise(F.col("rate.key"))
    return out.select("model", shown.alias("key"), source.alias("source"), *[F.col(f"rate.{c}").alias(c) for c in RATES])


def with_rates(rows: DataFrame, bundled: DataFrame, custom: DataFrame | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """``rows`` with rate_key, rate_source and rates of their models."""
    found = model_rates(rows.select("model"), bundled, custom, catalog).withColumnsRenamed({"model": "_model", "key": "rate_key", "source": "rate_source"})
    tag = lambda c: F.concat(F.when(c.isNull(), "-").otherwise("+"), F.coalesce(c, F.lit("")))  # noqa: E731  nulls don't join
    found = found.withColumn("_tag", tag(F.col("_model"))).drop("_model")
    return rows.withColumn("_tag", tag(F.col("model"))).join(found, "_tag", "left").drop("_tag")


def cost_parts(actual: Column | None = None) -> dict[str, Column]:
    """input_cost, output_cost, cache_cost and table_cost of a row with rates; scaled to ``actual`` where that is known and the table's isn't nothing."""
    t = {c: F.coalesce(F.col(c), F.lit(0)) for c in TOKENS}
    twice = F.when((F.col("long_context") > 0) & (t["input_tokens"] + t["cache_read_tokens"] >= F.col("long_context")), 2.0).otherwise(1.0)
    read = F.coalesce("cache_read_rate", F.col("input_rate") * 0.1) * twice
    write = F.coalesce("cache_write_rate", F.col("input_rate") * 1.25) * twice
    million = F.lit(1e6)
    into = t["input_tokens"] * (F.col("input_rate") * twice) / million
    out = t["output_tokens"] * (F.col("output_rate") * twice) / million
    cache = (t["cache_read_tokens"] * read + t["cache_write_tokens"] * write) / million
    total = into + out + cache
    scale = F.lit(1.0)
    if actual is not None:
        scale = F.when(actual.isNotNull() & (total > 1e-15) & (F.abs(actual - total) > 1e-12), actual / total).otherwise(1.0)
    return {"input_cost": into * scale, "output_cost": out * scale, "cache_cost": cache * scale, "table_cost": total}


def apply_pricing(rated: DataFrame, router_cost: str | None = "router_cost", prefer_router: bool = True, currency: str = "USD") -> DataFrame:
    """Rows with rates -> rows with total_tokens, estimated_cost, pricing_status and currency. A positive router cost comes before the table's."""
    total = token_sum()
    free = (total == 0) | ((F.col("input_rate") == 0) & (F.col("output_rate") == 0))
    table = F.when(free, 0.0).otherwise(cost_parts()["table_cost"])
    status = F.when(free, "zero_rate").when(F.col("rate_source") == "default", "unknown_model").otherwise("priced")
    router = F.coalesce(F.col(router_cost) > 0, F.lit(False)) if router_cost and prefer_router else F.lit(False)
    paid = F.when(router, F.col(router_cost)).otherwise(table) if router_cost else table
    return rated.withColumns(
        {
            "total_tokens": total,
            "estimated_cost": paid,
            "pricing_status": F.when(is_estimated(), "estimated").when(router, "priced").otherwise(status),
            "currency": F.lit(currency),
        }
    )


def price_events(rows: DataFrame, bundled: DataFrame, custom: DataFrame | None = None, catalog: DataFrame | None = None, router_cost: str = "router_cost", prefer_router: bool = True, keep_rates: bool = False) -> DataFrame:
    """``rows`` priced; a ``router_cost`` column is used if there is one. Rate columns are left out, unless reports are to find them."""
    own = router_cost if router_cost in rows.columns else None
    priced = apply_pricing(with_rates(rows, bundled, custom, catalog), own, prefer_router)
    return priced.drop("rate_key", "rate_source") if keep_rates else priced.drop(*RATES, "rate_key", "rate_source")


def reprice_events(rows: DataFrame, bundled: DataFrame, custom: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Costs anew after a change of rates: all rows if ``force``; else those without a positive cost and those of models with custom rates."""
    table = F.lit(force) | (F.coalesce(F.col("estimated_cost"), F.lit(0.0)) <= 0)
    kept = rows
    if custom is not None:
        own = custom.select(F.col("key").alias("_raw"), F.lit(True).alias("_own"))
        kept = rows.withColumn("_raw", raw_name(F.col("model"))).join(own, "_raw", "left").drop("_raw")
        table = table | F.coalesce("_own", F.lit(False))
    return price_events(kept.withColumn("router_cost", F.when(~table, F.col("estimated_cost"))), bundled, custom).drop("router_cost", "_own")


def pricing_catalog(seen: DataFrame, bundled: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """(model, key, source, rates) of every rate's name and every model seen (column model), by name."""
    names = bundled.filter("key <> 'default'").select(F.col("key").alias("model")).union(seen.select(F.coalesce(normalize_model(F.col("model")), "model")))
    if custom is not None:
        names = names.union(custom.select("key"))
    names = names.filter("model is not null and model <> ''").distinct()
    return model_rates(names, bundled, custom).orderBy("model")


def per_million(c: Column) -> Column:
    """USD a token -> USD a million tokens to six places; unknown and negative prices are 0."""
    n = c.try_cast("double")
    return F.when(F.isnan(n) | (n <= 0) | (n >= F.lit(float("inf"))), 0.0).otherwise(F.coalesce(F.floor(n * 1e6 * 1e6 + 0.5) / F.lit(1e6), F.lit(0.0)))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
