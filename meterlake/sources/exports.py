"""JSON snapshots and exports of usage rows, as other hosts and former versions write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import salvage, text, time
from ..functions.usage import fields
from ..schema import USAGE, conform, empty
from . import files

# Names of a row's fields in JSON, by column.
NAMES = {
    "id": "id", "agent": "agent", "model": "model", "ts": "timestamp", "input_tokens": "inputTokens", "output_tokens": "outputTokens", "cache_read_tokens": "cacheReadTokens", "cache_write_tokens": "cacheWriteTokens", "total_tokens": "totalTokens",
    "estimated_cost": "estimatedCost", "currency": "currency", "pricing_status": "pricingStatus", "workspace": "workspace", "source_path": "sourcePath", "estimated": "estimated", "request_count": "requestCount",
}


def read_export(spark: SparkSession, roots: list[str], name: str = r"\.json$", depth: int = 4) -> DataFrame:
    """Usage rows of JSON arrays, or of documents with an ``events`` array. Of a document that was cut off, the rows before the cut. Rows without id and agent are none."""
    documents = files.read_documents(spark, roots, name, depth)
    if documents.isEmpty():
        return empty(spark)
    doc = F.try_parse_json("value")
    listed = F.coalesce(*[F.try_variant_get(doc, p, "array<variant>") for p in ("$", "$.events")])
    whole = F.transform(listed, lambda v: F.to_json(v))
    rows = documents.select("path", F.posexplode(F.when(doc.isNotNull(), whole).otherwise(salvage.salvage(F.when(doc.isNull(), F.col("value"))))).alias("at", "json"))
    told = rows.withColumn("_r", fields(F.col("json"), list(NAMES.values())))
    types = {f.name: f.dataType.simpleString() for f in USAGE}

    def column(c: str, n: str):
        v = F.col("_r")[n]
        if c == "ts":
            return F.coalesce(time.instant(v), time.epoch(v))
        return text.num(v).cast("long") if types[c] == "bigint" and c not in ("request_count", "total_tokens") else v.try_cast(types[c])

    out = told.select("path", F.col("at").cast("long").alias("seq"), *[column(c, n).alias(c) for c, n in NAMES.items()])
    return conform(out.filter(F.col("id").isNotNull() & F.col("agent").isNotNull()))
