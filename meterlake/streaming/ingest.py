"""Continuous ingest: each batch of a stream is priced, merged into the days that it touches and committed. Late rows are always taken: days only grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import days
from ..functions import rates as R
from ..operators.dedup import path as file_of
from ..operators.merge import finalize
from ..operators.pricing import price_events
from ..schema import USAGE, conform, requests
from ..tables import cut, cut_tables


def stream_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Usage rows as JSON lines files that arrive in a folder; lines that don't parse are left out."""
    return spark.readStream.schema(USAGE).json(folder).filter("id is not null")


def _whole_file() -> Column:
    """The file of rows of which one file's are decided together, else null: windsurf's sessions, grok's streams."""
    of_file = ((F.col("agent") == "windsurf") & file_of().endswith(".pb")) | ((F.col("agent") == "grok") & file_of().endswith("updates.jsonl"))
    return F.when(of_file, file_of())


def touched_days(spark: SparkSession, snapshot: str, version: days.Version, batch: DataFrame) -> list[str]:
    """Days whose rows a batch may change: its own, and those that hold one of its ids or rows of its session files.

    Of the history only ids, agents and paths are read; the batch's keys are joined, not broadcast unchecked.
    """
    keys = lambda rows: rows.select(F.explode(F.array_compact(F.array(F.concat(F.lit("i"), "id"), F.concat(F.lit("f"), _whole_file())))).alias("key"), days.day_of().alias("day"))
    known = keys(days.read(spark, snapshot, version)).join(keys(batch).select("key").distinct(), "key", "left_semi").select("day")
    return [r.day for r in batch.select(days.day_of().alias("day")).union(known).distinct().collect()]  # as many as there are days


def merge_batch(batch: DataFrame, snapshot: str, machine: str, keep: int = 2) -> days.Version:
    """The history with a batch merged in; days that it doesn't touch keep their files.

    A batch may come twice: ids are stable and the merge is by id. Another writer's
    commit between reading and writing makes this one read and merge again. The last
    ``keep`` versions stay readable; tables of the merge itself are deleted.
    """
    spark = batch.sparkSession
    with cut_tables():
        priced = cut(conform(price_events(batch.withColumn("router_cost", F.col("estimated_cost")), R.rates(spark))))
        done = days.update(spark, snapshot, lambda v: touched_days(spark, snapshot, v, priced), lambda old: finalize(old.unionByName(priced), old, None, machine))
    days.clean(spark, snapshot, keep)
    return done


def ingest(rows: DataFrame, snapshot: str, checkpoint: str, machine: str = "local", once: bool = True, every: str = "60 seconds", name: str | None = None) -> StreamingQuery:
    """Start the stream: over what there is, or for good with a batch ``every`` so often."""
    trigger = {"availableNow": True} if once else {"processingTime": every}
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
    return (writer.queryName(name) if name else writer).foreachBatch(lambda b, _: merge_batch(b, snapshot, machine)).start()


def live_windows(rows: DataFrame, minutes: int = 3, late: str = "10 minutes") -> DataFrame:
    """Requests of each agent in sliding windows that advance by a minute; rows later than ``late`` don't count here."""
    w = F.window("ts", f"{minutes} minutes", "1 minute")
    return rows.filter(~F.coalesce("estimated", F.lit(False))).withWatermark("ts", late).groupBy(w.alias("window"), "agent").agg(F.sum(requests()).alias("requests"))
