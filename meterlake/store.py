"""Snapshots of usage rows as Parquet: written whole, swapped in, with the previous one kept."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import days
from .operators.dedup import richer_union
from .operators.merge import heal
from .operators.reports import sanitize
from .schema import conform, empty, weight
from .sources.exports import read_export


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _rename(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"{a} could not be renamed to {b}")


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Write beside the snapshot, then swap names; the old one stays as ``.bak``. Partitioned by UTC day.

    A writer that stops before the swap leaves the snapshot as it was; one that
    stops between the two renames leaves ``.bak``, which is then the snapshot for
    readers and isn't removed by the next writer.
    """
    spark = rows.sparkSession
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    dated = rows.withColumn("day", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown")))
    # a day's files are few, and a large day is split
    dated.repartition("day", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("day").parquet(staging)
    fs, live = _fs(spark, path)
    _, back = _fs(spark, f"{path}.bak")
    _, made = _fs(spark, staging)
    fs.mkdirs(live.getParent())
    if fs.exists(live):
        fs.delete(back, True)
        _rename(fs, live, back)
    _rename(fs, made, live)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot's rows, or the newest version of a history by days; those of the one before if a writer stopped between the renames; none if there is neither."""
    if days.exists(spark, path):
        return days.read(spark, path)
    for place in (path, f"{path}.bak"):
        fs, found = _fs(spark, place)
        if fs.exists(found):
            return conform(spark.read.parquet(place))
    return empty(spark)


def score(rows: DataFrame) -> tuple[int, int]:
    """(rows, tokens) of a snapshot."""
    n, tokens = rows.agg(F.count(F.lit(1)), F.sum(weight())).first()
    return int(n or 0), int(tokens or 0)


def better(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether snapshot a comes before b: over 50 rows more; not over 50 fewer and more tokens; or more rows and at least nine tenths of the tokens."""
    return a[0] > b[0] + 50 or (a[0] >= b[0] - 50 and a[1] > b[1]) or (a[0] > b[0] and a[1] >= b[1] * 0.9)


def load_best(spark: SparkSession, path: str) -> DataFrame:
    """The better of the snapshot and the one before, healed."""
    live, back = read_snapshot(spark, path), read_snapshot(spark, f"{path}.bak")
    return heal(back if better(score(back), score(live)) else live)


def best_of(parts: list[DataFrame]) -> DataFrame | None:
    """The snapshot that comes before all others; of equals the earlier one; None if all are empty."""
    best, top = None, (0, 0)
    for rows in parts:
        own = score(rows)
        if own[0] and (best is None or better(own, top)):
            best, top = rows, own
    return best


def load_history(spark: SparkSession, path: str, archives: list[str] | None = None, legacy: list[str] | None = None) -> DataFrame:
    """The best of a snapshot, the one before it and JSON ``archives``, with what former folders (``legacy``, JSON) have beyond it; healed.

    Former rows are merged by id, the richer one wins, so usage never falls when a folder moves.
    """

    def document(file: str) -> DataFrame:
        folder, _, name = file.rpartition("/")
        return read_export(spark, [folder], f"^{re.escape(name)}$", 0)

    parts = [read_snapshot(spark, path), read_snapshot(spark, f"{path}.bak"), *map(document, archives or [])]
    best, old = best_of(parts), best_of(list(map(document, legacy or [])))
    if old is not None:
        best = old if best is None else richer_union(best, old)
    return empty(spark) if best is None else heal(best)


def save_imported(rows: DataFrame, folder: str) -> None:
    """Rows of other hosts' exports, cleaned, as a snapshot of their own."""
    write_snapshot(sanitize(rows), f"{folder}/imported")


def load_imported(spark: SparkSession, folder: str, legacy: str | None = None) -> DataFrame:
    """Imported rows, and those of a former folder that are absent or richer there: by id, the richest."""
    rows = read_snapshot(spark, f"{folder}/imported")
    return sanitize(richer_union(rows, read_snapshot(spark, f"{legacy}/imported"))) if legacy else sanitize(rows)
