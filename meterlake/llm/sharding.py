"""Rendezvous hashing of stable record keys over weighted shards.

Each shard draws a cost ``-ln(u) / weight`` for a key, where u in (0, 1) is a
hash of key and shard number, and the key goes to the shard of least cost. The
draw of a shard doesn't depend on the others, so one more shard takes rows only
into itself, and a shard's share follows its weight. All of it is column
expressions; rows are not moved to decide their shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import aside, fresh, read


def _cost(key: Column, shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def assign_shards(rows: DataFrame, key: Column, weights: Sequence[float], grown: float | None = None) -> DataFrame:
    """``rows`` with ``shard``, and ``grown_shard`` under one more shard of weight ``grown`` (else null).

    A null key is a key of its own. Equal keys, and so repeated rows, share a shard;
    of equal costs the shard of the lower number takes the key. Columns of ``rows``
    named ``shard`` or ``grown_shard`` are returned with ``_in`` after them.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    names = {"shard", "grown_shard"}
    best, text = fresh(rows, "best"), fresh(rows, "key")
    drawn = aside(rows.withColumn(text, F.coalesce(key.cast("string"), F.lit("\0null"))), *names)
    draws = F.array(*[F.struct(_cost(F.col(text), i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)])
    out = drawn.withColumn(best, F.array_min(draws)).withColumn("shard", F.coalesce(F.col(f"{best}.shard"), F.lit(0)))  # never null: joins add no filter that draws again
    more = F.when(_cost(F.col(text), len(weights), grown) < F.col(f"{best}.cost"), F.lit(len(weights))).otherwise(F.col("shard")) if grown else F.lit(None).cast("int")
    return out.withColumn("grown_shard", more).drop(text, best)


def number_slots(rows: DataFrame, order: Sequence[str], group: str = "shard", buckets: int = 1024) -> DataFrame:
    """``rows`` with ``slot``: gapless numbers from 0 in each group.

    A group may hold any share of the rows, so it isn't sorted as a whole: rows
    are dealt into ``buckets`` hash buckets per group, counted, and numbered from
    the running count of the buckets before theirs. The counts are at most
    groups x buckets rows and are broadcast; groups must be few (shards are). Rows
    equal in ``order`` take neighbouring slots in any order. A column named ``slot``
    is returned with ``_in`` after its name; an empty table stays empty.
    """
    rows = aside(rows, "slot")
    bucket, start, place, n = (fresh(rows, x) for x in ("bucket", "start", "place", "n"))
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy(group, bucket).agg(F.count(F.lit(1)).alias(n))
    starts = counts.select(group, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    number = F.row_number().over(W.partitionBy(group, bucket).orderBy(*order)) - 1
    return dealt.withColumn(place, number).join(F.broadcast(starts), [group, bucket]).withColumn("slot", F.col(start) + F.col(place)).drop(bucket, place, start)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.col("text")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    placed = number_slots(assign_shards(rows, F.col("doc_id"), [1.0] * 24, grown=1.0), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
