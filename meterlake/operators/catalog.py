"""Rates from an external catalog of models (a JSON document that is read as a file)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import guess_provider, normalize_model, strip
from .pricing import RATES, model_rates, per_million

# Ends of names that say how a model runs, not which it is.
ENDS = [":batch", ":free", "-high", "-tiered", "-low", "-medium", "-xhigh", "-fast", "-exp", "-latest", "-preview"]
MOST_ENDS = 6


def parse_catalog(documents: DataFrame, document: str = "value") -> DataFrame:
    """Catalog rows from documents ``{"data": [{id, name, pricing, ...}]}``; ids that begin with ~ are left out."""
    price = "prompt:string,completion:string,input_cache_read:string,input_cache_write:string"
    schema = f"data array<struct<id:string,name:string,created:double,context_length:double,architecture:struct<modality:string>,pricing:struct<{price}>>>"
    rows = documents.select(F.from_json(document, schema).alias("d")).select(F.explode("d.data").alias("m")).select("m.*")
    rows = rows.withColumn("id", strip(F.col("id"))).filter((F.col("id") != "") & ~F.col("id").startswith("~"))
    at = F.locate("/", F.col("id"))
    cached = lambda c: F.when(F.col(f"pricing.{c}").isNotNull(), per_million(F.col(f"pricing.{c}")))
    out = rows.select(
        "id",
        strip(F.coalesce(F.nullif("name", F.lit("")), "id")).alias("name"),
        F.when(at > 1, F.substring("id", F.lit(1), at - 1)).otherwise("other").alias("provider"),
        F.when(at > 1, F.substring("id", at + 1, F.length("id"))).otherwise(F.col("id")).alias("slug"),
        F.coalesce(F.col("context_length").cast("long"), F.lit(0)).alias("context_length"),
        F.coalesce("architecture.modality", F.lit("text->text")).alias("modality"),
        per_million(F.col("pricing.prompt")).alias("input_rate"),
        per_million(F.col("pricing.completion")).alias("output_rate"),
        cached("input_cache_read").alias("cache_read_rate"),
        cached("input_cache_write").alias("cache_write_rate"),
        F.lit(None).cast("long").alias("long_context"),
        F.nullif(F.col("created").cast("long"), F.lit(0)).alias("created"),
    )
    return out.withColumn("free", (F.col("input_rate") == 0) & (F.col("output_rate") == 0))


def _peel(c: Column, end: str) -> Column:
    return F.when(c.endswith(end) & (F.length(c) > len(end) + 3), F.substring(c, F.lit(1), F.length(c) - len(end))).otherwise(c)


def lookup_candidates(model: Column) -> Column:
    """Names under which a catalog may have a model: as it is, without provider, without its ends one by one, as preview, and of its provider."""
    raw = F.replace(F.lower(strip(model)), F.lit("_"), F.lit("-"))
    bare = F.element_at(F.split(raw, "/"), -1)
    # one round tries every end in order; a name has few, and rounds beyond its last change nothing
    ends = F.flatten(F.array_repeat(F.array(*[F.lit(e) for e in ENDS]), MOST_ENDS))

    def step(seen: Column, end: Column) -> Column:
        c = F.element_at(seen, -1)
        shorter = F.when(c.endswith(end) & (F.length(c) > F.length(end) + 3), F.substring(c, F.lit(1), F.length(c) - F.length(end)))
        return F.when(shorter.isNotNull(), F.concat(seen, F.array(shorter))).otherwise(seen)

    seen = F.aggregate(ends, F.array(bare), step)
    last = F.element_at(seen, -1)
    preview = F.when(last.contains("gemini") & last.rlike("(^|-)pro$"), F.array(F.concat(last, F.lit("-preview")))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.array(raw), seen, preview))
    google = F.transform(F.filter(every, lambda c: ~c.contains("/") & c.startswith("gemini")), lambda c: F.concat(F.lit("google/"), c))
    return F.filter(F.array_distinct(F.concat(every, google)), lambda c: c != "")


def _score(raw: Column) -> Column:
    id_, slug = F.lower("id"), F.lower("slug")
    has = lambda t: id_.contains(t) | slug.contains(t)
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    google = raw.contains("gemini") | raw.startswith("google/")
    return (
        points(~F.col("free"), 200) + points(~has(":batch"), 80) + points(raw.contains("image") == has("image"), 40) + points(raw.contains("preview") == has("preview"), 30)
        + points(google & (F.lower("provider") == "google"), 50) + F.least(F.length("slug"), F.lit(80))
    )


#: Slugs of fewer characters aren't looked for within names.
WITHIN = 6


def _grams(name: Column) -> Column:
    """All stretches of ``WITHIN`` characters of a name."""
    return F.when(F.length(name) >= WITHIN, F.transform(F.sequence(F.lit(1), F.length(name) - WITHIN + 1), lambda i: name.substr(i, F.lit(WITHIN)))).otherwise(F.array().cast("array<string>"))


def lookup_catalog(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """(model, id, rates) for the models that the catalog has: by id, else by slug, else by the longest and best slug (6 or more) within the name.

    Names and rows meet by equal marks: ids, slugs, and the first characters of a
    slug with every stretch of that length in a name, so that no name is compared
    with all rows. The exact conditions follow.
    """
    raw = F.lower(strip(F.col("model")))
    wanted = models.select("model").distinct().withColumn("raw", raw).filter("raw <> ''").withColumn("cand", F.explode(lookup_candidates(F.col("model"))))
    bare, dashed = F.element_at(F.split("cand", "/"), -1), F.replace(F.col("raw"), F.lit("_"), F.lit("-"))
    rows = catalog.withColumns({"_id": F.lower("id"), "_slug": F.lower("slug"), "_bare": F.lower(F.element_at(F.split("id", "/"), -1))})
    mark = lambda kind, c: F.concat(F.lit(kind), c)
    within = F.transform(F.array_union(_grams(F.col("cand")), _grams(dashed)), lambda g: mark("w:", g))
    asked = wanted.withColumn("mark", F.explode(F.array_distinct(F.concat(F.array(mark("i:", F.col("cand")), mark("s:", bare), mark("s:", F.col("cand")), mark("b:", bare)), within))))
    held = rows.withColumn("mark", F.explode(F.array_distinct(F.array_compact(F.array(mark("i:", F.col("_id")), mark("s:", F.col("_slug")), mark("b:", F.col("_bare")), F.when(F.length("_slug") >= WITHIN, mark("w:", F.substring("_slug", 1, WITHIN))))))))
    tier = (
        F.when(F.col("_id") == F.col("cand"), 3)
        .when((F.col("_slug") == bare) | (F.col("_slug") == F.col("cand")) | (F.col("_bare") == bare), 2)
        .when((F.length("_slug") >= WITHIN) & (~F.col("_slug").contains(":batch") | F.col("cand").contains("batch")) & (F.col("cand").contains(F.col("_slug")) | dashed.contains(F.col("_slug"))), 1)
    )
    met = asked.join(held, "mark").withColumn("tier", tier).filter("tier is not null")
    best = F.max_by(F.struct("id", *RATES), F.struct("tier", _score(F.col("raw")), F.length("slug"), F.lit("")))
    return met.groupBy("model").agg(best.alias("b")).select("model", "b.*")


def model_catalog(catalog: DataFrame, seen: DataFrame, bundled: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """The catalog with custom rates in place, and below it bundled, custom and seen models that it lacks; newest first, then by name."""
    own = custom if custom is not None else bundled.limit(0)
    rate = F.struct(*RATES[:4])
    by_id = own.select(F.col("key").alias("_id"), rate.alias("by_id"))
    by_slug = own.select(F.col("key").alias("_slug"), rate.alias("by_slug"))
    listed = catalog.withColumns({"_id": F.lower("id"), "_slug": F.lower("slug")}).join(by_id, "_id", "left").join(by_slug, "_slug", "left")
    mine = F.coalesce("by_id", "by_slug")
    pick = lambda c: F.coalesce(mine[c], F.col(c)).alias(c)
    shown = ["id", "name", "provider", "slug", "context_length", "modality", "source", *RATES[:4], "created", "free"]
    listed = listed.select("id", "name", "provider", "slug", "context_length", "modality", F.when(mine.isNotNull(), "custom").otherwise("catalog").alias("source"), *[pick(c) for c in RATES[:4]], F.coalesce("created", F.lit(0)).alias("created"), "free")
    names = bundled.select("key", F.lit("bundled").alias("kind"), F.lit(0).alias("o")).union(own.select("key", F.lit("custom"), F.lit(1))).union(seen.select("model", F.lit("seen"), F.lit(2)))
    names = names.filter(F.col("key").isNotNull() & (strip(F.col("key")) != "") & ~F.col("key").isin("default", "mixed", "XLab") & ~F.col("key").rlike("(?i)^9router-"))
    names = names.withColumn("norm", F.coalesce(normalize_model(F.col("key")), "key")).withColumn("low", F.lower("norm"))
    names = names.groupBy("low").agg(F.min_by(F.struct("key", "kind", "norm"), F.struct("o", "key")).alias("n")).select("low", "n.*")
    ends = catalog.select(F.explode(F.array(F.lower("id"), F.lower("slug"), F.lower(F.element_at(F.split("id", "/"), -1)))).alias("low")).distinct()
    lacking = names.join(ends, "low", "left_anti")
    rated = lacking.join(model_rates(lacking.select(F.col("key").alias("model")), bundled, custom).withColumnRenamed("key", "rate_key").withColumnRenamed("model", "key"), "key")
    provider = guess_provider(F.col("norm"))
    id_ = F.when(F.col("norm").contains("/"), F.col("norm")).otherwise(F.concat(provider, F.lit("/"), "norm"))
    rated = rated.select(
        id_.alias("id"), F.col("norm").alias("name"), provider.alias("provider"), F.element_at(F.split("norm", "/", 2), -1).alias("slug"), F.lit(0).cast("long").alias("context_length"), F.lit("text->text").alias("modality"),
        F.when(F.col("source").isin("custom", "bundled"), F.col("source")).otherwise(F.col("kind")).alias("source"), *RATES[:4], F.lit(0).cast("long").alias("created"), ((F.col("input_rate") == 0) & (F.col("output_rate") == 0)).alias("free"),
    )
    return listed.select(*shown).unionByName(rated.select(*shown)).orderBy(F.col("created").desc(), F.lower("name"), "id")
