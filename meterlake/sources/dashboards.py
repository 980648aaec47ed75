"""Readers of dashboard exports: lists of models, or totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, usage
from ..functions.usage import fields
from ..operators.sequences import first_wins
from ..schema import conform
from . import files


def read_dashboards(spark: SparkSession, roots: list[str], agent: str = "qwencoder") -> DataFrame:
    """One row for each model of an export; of equal ids the first by path and place. Tokens that aren't split count as input."""
    documents = files.read_documents(spark, roots).withColumn("doc", F.try_parse_json("value")).filter("doc is not null")
    lists = [F.try_variant_get("doc", p, "array<variant>") for p in ("$.data.models", "$.models", "$.data.stats.models")]
    named = documents.withColumn("models", F.coalesce(*lists, F.array(F.coalesce(usage.obj(F.col("doc"), "totals"), usage.obj(F.col("doc"), "data"))))).select("*", F.posexplode("models").alias("place", "m")).filter("m is not null")
    rows = named.withColumn("_r", fields(F.to_json("m"), ["model", "name", "input_tokens", "output_tokens", "tokens", "total_tokens", "requests", "cost"]))
    n = lambda *names: text.num(F.coalesce(*[F.col(f"_r.{x}") for x in names]))
    day = F.date_format("at", "yyyy-MM-dd")
    out = rows.withColumn("at", F.coalesce(usage.time.instant(usage.get(F.col("doc"), "scrapedAt")), F.col("mtime"))).select(
        F.struct("path", "place").alias("_at"), F.col("place").cast("long").alias("seq"), text.stable_id(F.lit(agent), day, F.coalesce("_r.model", "_r.name", F.lit("all"))).alias("id"), F.lit(agent).alias("agent"), text.normalize_model(F.coalesce("_r.model", "_r.name")).alias("model"), F.col("at").alias("ts"),
        n("input_tokens", "tokens", "total_tokens").cast("long").alias("input_tokens"), n("output_tokens").cast("long").alias("output_tokens"), F.lit(0).alias("cache_read_tokens"), F.lit(0).alias("cache_write_tokens"),
        F.col("path").alias("source_path"), F.lit(True).alias("estimated"), F.nullif(n("requests").cast("long"), F.lit(0)).alias("request_count"), F.nullif(n("cost"), F.lit(0.0)).alias("estimated_cost"),
    )
    return conform(first_wins(out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).filter("total_tokens > 0"), "id", "_at"))
