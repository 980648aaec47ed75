"""The canonical usage row, and the agents whose logs can be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One API call, one turn or session, or one rollup. ``seq`` is the order of ingestion, which settles ties: the earlier row wins.
USAGE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cache_read_tokens", T.LongType()),
        T.StructField("cache_write_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("estimated_cost", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("pricing_status", T.StringType()),
        T.StructField("workspace", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("estimated", T.BooleanType()),
        T.StructField("request_count", T.LongType()),
    ]
)
COLUMNS = USAGE.fieldNames()
TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]

# Agents whose rows come from request routers, with day rollups beside requests.
ROUTERS = ["9router", "xlabrouter", "routerlab", "litellm"]


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], USAGE)


def conform(rows: DataFrame) -> DataFrame:
    """``rows`` with all canonical columns, in order and type; absent ones are null, other columns go."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in USAGE.fields])


def is_router(agent: Column) -> Column:
    return agent.isin(ROUTERS)


def requests(count: Column | None = None) -> Column:
    """API requests that a row stands for: its count if positive, else one."""
    c = F.col("request_count") if count is None else count
    return F.when(c > 0, F.floor(c)).otherwise(1).cast("long")


def token_sum() -> Column:
    total = F.lit(0).cast("long")
    for c in TOKENS:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return total


def weight() -> Column:
    """Tokens of a row: the recorded total, else the sum of the buckets."""
    return F.coalesce(F.col("total_tokens"), token_sum())


def cost() -> Column:
    return F.coalesce(F.col("estimated_cost"), F.lit(0.0))


def has_model() -> Column:
    return F.coalesce(F.length(F.trim("model")) > 0, F.lit(False))


def is_estimated() -> Column:
    return F.coalesce(F.col("estimated"), F.lit(False))


def day() -> Column:
    """UTC day as text, null without a time."""
    return F.date_format("ts", "yyyy-MM-dd")


def second() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
