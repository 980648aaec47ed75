"""Rates of requests: over active minutes, in a sliding window, and by minute."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import time
from ..schema import cost, is_estimated, requests, token_sum
from .reports import is_live


def minute(ts: Column) -> Column:
    return F.floor(F.unix_millis(ts) / 60_000)


def active_rpm(rows: DataFrame) -> DataFrame:
    """(requests, active_minutes, rpm): requests a minute, over the minutes that have any. Idle time doesn't count."""
    sums = rows.agg(F.coalesce(F.sum(requests()), F.lit(0)).cast("long").alias("requests"), F.count_distinct(minute(F.col("ts"))).alias("active_minutes"))
    return sums.withColumn("rpm", F.round(F.when(F.col("active_minutes") > 0, F.col("requests") / F.col("active_minutes")).otherwise(0.0), 9))


def window_minutes(minutes: float) -> int:
    return max(1, min(60, int(minutes) or 3))


def counted(rows: DataFrame, now: datetime, minutes: int) -> DataFrame:
    """Real calls with usage in (now - minutes, now], a little clock skew allowed, with their number of requests ``n``."""
    inside = (F.col("ts") > time.moment(now - timedelta(minutes=minutes))) & (F.col("ts") <= time.moment(now + time.SKEW))
    real = rows.filter(~is_estimated() & inside & ((token_sum() > 0) | (cost() > 0)))
    rc = F.col("request_count")
    return real.withColumn("n", F.when((rc > 0) & (rc <= 100), F.floor(rc)).otherwise(1).cast("long"))


def live_rate(rows: DataFrame, now: datetime, minutes: float = 3) -> DataFrame:
    """(window_minutes, requests, rpm, rps): the mean over the window that ends now."""
    m = window_minutes(minutes)
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    out = counted(rows, now, m).agg(n.alias("requests"))
    return out.select(F.lit(m).alias("window_minutes"), "requests", F.round(F.col("requests") / (m * 60) * 60, 9).alias("rpm"), F.round(F.col("requests") / (m * 60), 9).alias("rps"))


def minute_slots(rows: DataFrame, now: datetime, minutes: float = 3) -> DataFrame:
    """(offset, requests) of each minute of the window, empty ones too; offset is the age, oldest first."""
    m = window_minutes(minutes)
    age = F.floor((F.unix_millis(time.moment(now)) - F.unix_millis("ts")) / 60_000)
    found = counted(rows, now, m).groupBy(F.least(F.lit(m - 1), F.greatest(F.lit(0), age)).cast("int").alias("offset")).agg(F.sum("n").alias("n"))
    slots = rows.sparkSession.range(m).select(F.col("id").cast("int").alias("offset"))
    return slots.join(found, "offset", "left").select("offset", F.coalesce("n", F.lit(0)).cast("long").alias("requests")).orderBy(F.col("offset").desc())


def last_request(rows: DataFrame, now: datetime) -> DataFrame:
    """(last_at, age_seconds) of the newest live call."""
    out = rows.filter(is_live() & (F.col("ts") <= time.moment(now + time.SKEW))).agg(F.max("ts").alias("last_at"))
    age = F.round((F.unix_millis(time.moment(now)) - F.unix_millis("last_at")) / 1000.0)
    return out.withColumn("age_seconds", F.greatest(F.lit(0), age).cast("long"))


def sliding_rate(rows: DataFrame, minutes: int = 3) -> DataFrame:
    """``rows`` with the requests of their agent in the minutes up to theirs.

    Windows are by agent and overlapping stretch of time: a row also goes to the
    next stretch as context, so that an agent with most rows is spread over many
    tasks.
    """
    span = minutes * 60_000_000
    stretch = 3600_000_000 * 6
    us = F.unix_micros("ts")
    own = F.floor(us / stretch)
    real = rows.filter(~is_estimated() & F.col("ts").isNotNull()).withColumns({"us": us, "own": own, "n": requests()})
    copies = real.withColumn("part", F.explode(F.when(F.floor((us + span) / stretch) > own, F.array(own, own + 1)).otherwise(F.array(own))))
    w = W.partitionBy("agent", "part").orderBy("us").rangeBetween(-span, 0)
    return copies.withColumn("window_requests", F.sum("n").over(w).cast("long")).filter("part = own").select("id", "agent", "ts", "window_requests")
