"""The reader that most agents share: JSON lines and documents with a usage object somewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, usage
from ..schema import conform
from . import files

# Where a row may hold its usage object, in order of trial.
CANDIDATES = ["usage", "token_usage", "tokenUsage", "token_count", "message"]


def usage_rows(rows: DataFrame, agent: str) -> DataFrame:
    """(path, mtime, line_no, row) -> usage rows without prices; rows without tokens are left out.

    The id depends on agent, file, row number and counts. A row without a time takes its file's.
    """
    found = F.coalesce(*[F.when(usage.kind_of(F.col("row"), n) != "VOID", F.try_variant_get("row", f"$.{n}", "variant")) for n in CANDIDATES], F.col("row"))
    message = F.try_variant_get("row", "$.message", "variant")
    with_counts = usage.with_buckets(rows.withColumn("_found", found), F.col("_found"))
    where = F.coalesce(*[F.when(usage.kind_of(F.col("row"), n) == "STRING", usage.get(F.col("row"), n)) for n in ("cwd", "workspace")])
    out = with_counts.select(
        F.col("line_no").alias("seq"),
        text.stable_id(F.lit(agent), F.col("path"), F.col("line_no"), F.col("b.input"), F.col("b.output")).alias("id"),
        F.lit(agent).alias("agent"),
        usage.model_of(F.col("row"), message).alias("model"),
        usage.time_of(F.col("row"), message, fallback=F.col("mtime")).alias("ts"),
        F.col("b.input").alias("input_tokens"),
        F.col("b.output").alias("output_tokens"),
        F.col("b.cache_read").alias("cache_read_tokens"),
        F.col("b.cache_write").alias("cache_write_tokens"),
        where.alias("workspace"),
        F.col("path").alias("source_path"),
        F.lit(False).alias("estimated"),
    )
    return conform(out)


def read_rows(spark: SparkSession, roots: list[str], name: str, depth: int = 10) -> DataFrame:
    """(path, mtime, line_no, row) of JSON lines files and of other files that are JSON documents."""
    lines = files.read_json_lines(spark, roots, rf"(?=.*\.jsonl$)(?:{name})", depth)
    documents = files.explode_documents(files.read_documents(spark, roots, rf"(?!.*\.jsonl$)(?:{name})", depth))
    return lines.select("path", "mtime", "line_no", "row").unionByName(documents)


def read_usage(spark: SparkSession, roots: list[str], agent: str, name: str = r".*\.jsonl?$", depth: int = 10) -> DataFrame:
    return usage_rows(read_rows(spark, roots, name, depth), agent)
